"""Patterns of economic and social figures (fixed values).

Three recurring shapes are written once: {vnd} an amount in billion dong with
thousands separators, {pct} a signed percentage, {musd} million dollars.
"""

SHAPES = {
    "vnd": r"(\d{1,3})[.,](\d{3})(?:[.,](\d{3}))?\s*tỷ",
    "vnd2": r"(\d{1,2})[.,](\d{3})(?:[.,](\d{3}))?\s*tỷ",
    "vnds": r"(\d{1,3})[.,](\d{3})\s*tỷ",
    "pct": r"(?:tăng|giảm)\s+(\d+[.,]\d+)\s*%",
    "musd": r"(\d+[.,]\d+)\s*triệu\s*USD",
}


def full(pattern: str) -> str:
    """Pattern with its shapes filled in, Unicode-aware and case-insensitive."""
    for name, shape in SHAPES.items():
        pattern = pattern.replace("{" + name + "}", shape)
    return "(?iU)" + pattern


# Keywords per indicator.
KEYWORDS = {
    "grdp": ["grdp", "tổng sản phẩm trên địa bàn", "tổng sản phẩm địa bàn", "gdp", "quy mô kinh tế", "tăng trưởng kinh tế", "giá hiện hành", "giá so sánh"],
    "iip": ["iip", "chỉ số sản xuất công nghiệp", "sản xuất công nghiệp", "công nghiệp chế biến", "chế biến chế tạo", "giá trị sản xuất công nghiệp"],
    "agri": ["nông nghiệp", "sản xuất nông nghiệp", "nông lâm nghiệp", "nông lâm thủy sản", "trồng trọt", "chăn nuôi", "giá trị sản xuất nông nghiệp"],
    "retail": ["bán lẻ", "tổng mức bán lẻ", "dịch vụ tiêu dùng", "bán lẻ hàng hóa", "doanh thu dịch vụ", "thương mại dịch vụ"],
    "export": ["kim ngạch xuất khẩu", "tổng kim ngạch xuất khẩu", "hàng hóa xuất khẩu", "giá trị xuất khẩu hàng hóa", "kim ngạch hàng hóa xuất khẩu"],
    "investment": ["đầu tư", "fdi", "vốn đầu tư", "thu hút đầu tư", "đầu tư nước ngoài", "vốn đăng ký", "ddi", "tổng vốn đầu tư", "vốn đầu tư phát triển"],
    "budget": ["ngân sách", "thu ngân sách", "thu thuế", "thu nội địa", "ngân sách nhà nước", "tổng thu ngân sách"],
    "cpi": ["cpi", "chỉ số giá", "chỉ số giá tiêu dùng", "lạm phát", "giá tiêu dùng bình quân"],
}

# Words that raise a context.
# Months as words, and the indicators whose figures of a single month do not count for a year.
MONTH_NAMES = ["tháng Một", "tháng Hai", "tháng Ba", "tháng Tư", "tháng Năm", "tháng Sáu", "tháng Bảy", "tháng Tám", "tháng Chín", "tháng Mười"]
BY_YEAR_ONLY = ["retail", "budget"]

PRIORITY_WORDS = {
    "iip": ["(iip)", "chỉ số sản xuất công nghiệp (iip)"],
    "retail": ["tổng mức bán lẻ", "năm 20", "cả năm", "quý"],
    "investment": ["tổng vốn đầu tư"],
    "budget": ["thu ngân sách nhà nước", "tổng thu ngân sách"],
    "agri": ["giá trị sản xuất nông nghiệp", "nông, lâm nghiệp và thủy sản", "giá trị sản xuất"],
    "export": ["kim ngạch xuất khẩu", "tổng kim ngạch xuất khẩu", "kim ngạch hàng hóa xuất khẩu"],
}

# Words that lower a context: it is about a part, not the whole.
DETAIL_WORDS = {
    "budget": ["thu từ khu vực", "thu nội địa", "thu thuế môn bài", "thu từ doanh nghiệp", "các khoản thu về đất"],
    "retail": ["doanh thu dịch vụ lưu trú", "doanh thu bán lẻ hàng hóa", "dịch vụ lưu trú, ăn uống", "doanh thu bán lẻ xăng dầu", "vốn đầu tư", "vốn ngân sách"],
    "investment": ["vốn đầu tư của", "dự án"],
    "agri": ["ống dẫn", "thép", "sắt", "máy giặt", "nitơrat", "chăn nuôi", "trồng trọt", "lâm nghiệp", "thủy sản", "chế biến", "cây công nghiệp", "rau màu"],
    "export": ["vốn", "tín dụng", "dư nợ", "cho vay", "nông nghiệp, nông thôn", "doanh nghiệp nhỏ", "công nghiệp hỗ trợ", "ứng dụng công nghệ cao"],
}

# Words inside a match that veto it.
VETO_WORDS = {
    "agri": ["tạ/ha", "tấn", "năng suất", "sản lượng", "diện tích", "ha"],
    "retail": ["xăng dầu", "lưu trú", "ăn uống", "tháng một", "tháng hai", "tháng ba"],
    "budget": ["thu từ", "khu vực", "nội địa", "thuế môn bài", "thu đất"],
    "investment": ["của doanh nghiệp", "khu vực", "từ fdi"],
    "iip": ["chế biến", "khai khoáng", "điện", "ngành", "phân ngành"],
    "export": ["vốn", "tín dụng", "dư nợ", "cho vay"],
}

# (pattern, kind) per indicator, in order: a later match overwrites an earlier one.
INDICATORS = {
    "iip": [(p, "growth") for p in [
        r"\(IIP\)\s*(?!.*(?:chế biến|khai khoáng|điện)).*?{pct}",
        r"IIP(?!.*(?:ngành|phân ngành|khu vực))\s*{pct}",
        r"Chỉ số sản xuất công nghiệp\s*\(IIP\)(?!.*(?:chế biến|khai khoáng))\s*{pct}",
        r"(?:năm|cả năm).*?IIP.*?{pct}",
        r"IIP.*?(?:năm|cả năm).*?{pct}",
        r"chỉ số sản xuất công nghiệp.*?(?:năm \d{4}|cả năm).*?{pct}",
        r"quý [IVX1-4].*?IIP.*?{pct}",
        r"IIP.*?quý [IVX1-4].*?{pct}",
        r"(?:3|6|9) tháng đầu năm.*?IIP.*?{pct}",
        r"tháng \d+.*?IIP.*?{pct}",
        r"IIP.*?tháng [^,]+.*?{pct}",
        r"IIP.*?(?:đạt|ước đạt|thực hiện).*?{pct}",
        r"chỉ số.*?công nghiệp.*?(?:tăng trưởng|tăng)\s+(\d+[.,]\d+)\s*%",
        r"chỉ số sản xuất công nghiệp.*?{pct}"]],
    "retail": [(p, "value_split") for p in [
        r"(?:năm \d{4}|cả năm)(?!.*tháng (?:Một|Hai|Ba|Tư|Năm|Sáu|Bảy|Tám|Chín|Mười)).*?tổng mức bán lẻ(?!.*(?:xăng dầu|lưu trú|ăn uống)).*?{vnd}",
        r"tổng mức bán lẻ(?!.*(?:xăng|lưu trú)).*?(?:năm \d{4}|cả năm)(?!.*tháng (?:Một|Hai)).*?{vnd}",
        r"tổng mức bán lẻ hàng hóa và doanh thu dịch vụ(?!.*(?:lưu trú|xăng)).*?năm \d{4}.*?{vnd}",
        r"năm \d{4}.*?tổng mức bán lẻ hàng hóa, dịch vụ(?!.*tháng).*?{vnd}",
        r"quý [IVX1-4].*?tổng mức bán lẻ.*?{vnd2}",
        r"tổng mức bán lẻ.*?quý [IVX1-4].*?{vnd2}",
        r"(?:3|6|9) tháng đầu năm.*?tổng mức bán lẻ.*?{vnd2}",
        r"tổng mức bán lẻ.*?(?:3|6|9) tháng.*?{vnd2}",
        r"tổng mức bán lẻ.*?(?:đạt|ước đạt|đạt được).*?{vnd}",
        r"(?:đạt|ước đạt).*?tổng mức bán lẻ.*?{vnd}",
        r"tổng mức bán lẻ hàng hóa, dịch vụ.*?(?:đạt|ước).*?{vnd}",
        r"tổng mức bán lẻ hàng hóa và doanh thu dịch vụ(?!.*tháng Một|tháng Hai|tháng Ba).*?{vnd}",
        r"tổng mức bán lẻ hàng hoá, dịch vụ tiêu dùng.*?{vnd}",
        r"tổng mức bán lẻ(?!.*tháng (?:Một|Hai|Ba|Tư|Năm|Sáu|Bảy|Tám|Chín|Mười)).*?{vnd}"]] + [(p, "growth") for p in [
        r"tổng mức bán lẻ[^.;]*{pct}",
        r"bán lẻ hàng hóa[^.;]*{pct}",
        r"tổng mức bán lẻ.*?tăng trưởng.*?(\d+[.,]\d+)\s*%",
        r"{pct}[^.;]*tổng mức bán lẻ"]],
    "budget": [(p, "value_split") for p in [
        r"thu ngân sách trên địa bàn(?!.*(?:thu từ|khu vực|nội địa))[^.;]{0,50}(?:đạt|ước đạt)[^.;]{0,30}{vnd}",
        r"tổng thu ngân sách(?!.*(?:thu từ|thu thuế môn bài))[^.;]{0,50}(?:đạt|ước)[^.;]{0,30}{vnd}",
        r"thu ngân sách nhà nước(?!.*(?:thu từ|thu nội))[^.;]{0,50}{vnd}",
        r"thu ngân sách(?!.*(?:thu từ khu vực|thu nội địa|thu thuế môn))[^.;]{0,50}(?:đạt|ước đạt|thực hiện)[^.;]{0,30}{vnd}",
        r"{vnd}[^.;]{0,40}thu ngân sách(?!.*thu nội địa)",
        r"(?:năm|cả năm)[^.;]{0,40}thu ngân sách[^.;]{0,30}{vnd}",
        r"quý [IVX1-4].*?thu ngân sách.*?{vnd2}",
        r"(?:3|6|9) tháng.*?thu ngân sách.*?{vnd2}",
        r"(?:đạt|ước đạt).*?{vnd}.*?thu ngân sách",
        r"{vnd}.*?thu ngân sách(?!.*thu thuế môn bài)"]] + [(p, "growth") for p in [
        r"thu ngân sách.*?{pct}",
        r"{pct}.*?thu ngân sách",
        r"thu ngân sách.*?tăng trưởng.*?(\d+[.,]\d+)\s*%"]],
    "cpi": [
        (r"(?:CPI|chỉ số giá tiêu dùng|chỉ số giá).*?tăng\s+(\d+)[,.](\d+)\s*%", "cpi_growth"),
        (r"(?:CPI|chỉ số giá).*?bình quân.*?tăng\s+(\d+)[,.](\d+)\s*%", "cpi_growth"),
        (r"(?:CPI|chỉ số giá).*?đạt\s+(\d+)[,.](\d+)", "cpi_value")],
    "agri": [(p, "value_split") for p in [
        r"giá trị sản xuất nông nghiệp(?!.*(?:tạ/ha|tấn))[^.;]+{vnds}\s*(?:đồng|VND)?",
        r"nông, lâm nghiệp và thủy sản[^.;]+giá trị(?!.*(?:tạ|tấn|ha))[^.;]+{vnds}",
        r"sản xuất nông nghiệp[^.;]+giá trị[^.;]+{vnds}\s*(?:đồng|VND)"]] + [(p, "growth") for p in [
        r"giá trị sản xuất nông nghiệp(?!.*(?:năng suất|sản lượng|diện tích)).*?{pct}",
        r"nông, lâm nghiệp và thủy sản(?!.*(?:diện tích|sản lượng|năng suất|tạ|tấn)).*?{pct}",
        r"nông nghiệp.*?tăng trưởng(?!.*(?:diện tích|năng suất)).*?(\d+[.,]\d+)\s*%",
        r"(?:năm|cả năm).*?nông nghiệp.*?{pct}",
        r"quý [IVX1-4].*?nông.*?{pct}"]],
    "investment": [(p, "value_split") for p in [
        r"tổng vốn đầu tư (?:phát triển )?toàn xã hội(?!.*FDI).*?(?:đạt|ước đạt|ước).*?{vnd}",
        r"tổng vốn đầu tư phát triển(?!.*FDI).*?(?:đạt|ước đạt|đạt được).*?{vnd}",
        r"tổng vốn đầu tư(?!.*(?:FDI|của|doanh nghiệp)).*?(?:đạt|ước).*?{vnd}",
        r"(?:đạt|ước đạt).*?tổng vốn đầu tư(?!.*FDI).*?{vnd}",
        r"vốn đầu tư phát triển toàn xã hội.*?{vnd}\s*(?:đồng|VND)",
        r"(?:năm|cả năm).*?tổng vốn đầu tư.*?{vnds}",
        r"quý [IVX1-4].*?vốn đầu tư.*?{vnds}",
        r"(?:3|6|9) tháng.*?vốn đầu tư.*?{vnds}"]] + [(p, "value_usd") for p in [
        r"FDI.*?(?:đạt|ước).*?(\d+[.,]\d+)\s*(?:tỷ\s*USD|triệu\s*USD)",
        r"vốn đầu tư nước ngoài.*?(\d+[.,]\d+)\s*(?:tỷ|triệu)\s*(?:USD|đô)",
        r"vốn đăng ký.*?FDI.*?{musd}"]] + [(p, "growth") for p in [
        r"tổng vốn đầu tư.*?{pct}",
        r"vốn đầu tư.*?tăng trưởng.*?(\d+[.,]\d+)\s*%",
        r"{pct}.*?vốn đầu tư"]],
    "export": [(p, "value_usd") for p in [
        r"kim ngạch xuất khẩu.*?(?:đạt|ước đạt).*?{musd}",
        r"xuất khẩu.*?(?:đạt|ước).*?(\d+[.,]\d+)\s*triệu\s*(?:USD|đô)",
        r"giá trị xuất khẩu.*?{musd}",
        r"tổng kim ngạch.*?{musd}",
        r"(?:năm|cả năm).*?xuất khẩu.*?(\d+[.,]\d+)\s*triệu",
        r"quý [IVX1-4].*?xuất khẩu.*?(\d+[.,]\d+)\s*triệu"]] + [(p, "growth") for p in [
        r"xuất khẩu.*?{pct}",
        r"kim ngạch.*?{pct}"]],
    "grdp": [(p, "growth") for p in [
        r"GRDP.*?{pct}",
        r"tổng sản phẩm.*?địa bàn.*?{pct}",
        r"tăng trưởng.*?GRDP.*?(\d+[.,]\d+)\s*%",
        r"GRDP.*?tăng trưởng.*?(\d+[.,]\d+)\s*%"]] + [(p, "value_split") for p in [
        r"GRDP.*?(?:đạt|ước).*?{vnds}",
        r"tổng sản phẩm.*?{vnds}",
        r"(?:đạt|ước đạt).*?GRDP.*?{vnds}"]] + [(r"(?:năm|cả năm).*?GRDP.*?{pct}", "growth")],
}

# Indicators without a generic fallback and without a forecast.
GROWTH_ONLY = ("iip", "agri")

# Components per indicator: field, kind, patterns; the first match counts.
COMPONENTS = {
    "retail": [
        ("retail_value", "value_split", [r"bán lẻ hàng hóa.*?{vnd}", r"doanh thu bán lẻ.*?{vnd}"]),
        ("services_value", "value_split", [r"doanh thu dịch vụ(?!.*lưu trú).*?{vnd}", r"dịch vụ tiêu dùng.*?{vnd}"])],
    "export": [("export_usd", "number", [r"kim ngạch xuất khẩu.*?{musd}", r"xuất khẩu.*?đạt.*?{musd}"])],
    "investment": [
        ("fdi_registered", "number", [r"vốn đăng ký.*?FDI.*?{musd}", r"FDI.*?đăng ký.*?{musd}", r"vốn FDI đăng ký.*?{musd}"]),
        ("fdi_disbursed", "number", [r"vốn giải ngân.*?{musd}", r"FDI.*?giải ngân.*?{musd}", r"vốn thực hiện.*?FDI.*?{musd}"]),
        ("fdi_projects_new", "number", [r"(\d+)\s*dự án mới", r"cấp mới.*?(\d+)\s*dự án"]),
        ("fdi_projects_expanded", "number", [r"(\d+)\s*dự án điều chỉnh", r"điều chỉnh.*?(\d+)\s*dự án"]),
        ("ddi_value", "value_split", [r"DDI.*?{vnd}", r"đầu tư trong nước.*?{vnd}"]),
        ("public_investment", "value_split", [
            r"vốn ngân sách[^.;]{0,50}{vnd}", r"đầu tư công[^.;]{0,50}{vnd}", r"vốn đầu tư công[^.;]{0,50}{vnd}", r"vốn nhà nước[^.;]{0,50}{vnd}",
            r"trong đó[^.;]*vốn ngân sách[^.;]{0,50}{vnd}", r"trong đó[^.;]*đầu tư công[^.;]{0,50}{vnd}",
            r"{vnd}[^.;]{0,30}(?:vốn ngân sách|đầu tư công)"])],
    "budget": [
        ("tax_revenue", "value_split", [r"thu nội địa[^.;]{0,50}?{vnd}", r"trong đó[^.;]*thu nội địa[^.;]{0,50}?{vnd}", r"thu thuế[^.;]{0,50}?{vnd}", r"thu từ thuế[^.;]{0,50}?{vnd}"]),
        ("land_revenue", "value_split", [r"thu từ đất.*?{vnd}", r"các khoản thu về đất.*?{vnd}"]),
        ("budget_target", "value_split", [r"dự toán.*?{vnd}", r"kế hoạch.*?ngân sách.*?{vnd}"]),
        ("execution_rate", "number", [r"đạt.*?(\d+[.,]\d+)\s*%.*?(?:dự toán|kế hoạch)", r"(\d+[.,]\d+)\s*%.*?dự toán"])],
    "cpi": [
        ("cpi_food", "index", [r"(?:nhóm|chỉ số).*?lương thực.*?{pct}", r"hàng ăn.*?{pct}"]),
        ("cpi_housing", "index", [r"nhà ở.*?{pct}", r"thuê nhà.*?{pct}"]),
        ("cpi_transport", "index", [r"giao thông.*?{pct}", r"vận chuyển.*?{pct}"]),
        ("cpi_education", "index", [r"giáo dục.*?{pct}"]),
        ("cpi_healthcare", "index", [r"y tế.*?{pct}", r"dược phẩm.*?{pct}"]),
        ("core_cpi", "index", [r"CPI cơ bản.*?{pct}", r"lạm phát cơ bản.*?(\d+[.,]\d+)\s*%"]),
        ("inflation_rate", "number", [r"lạm phát.*?(\d+[.,]\d+)\s*%", r"tỷ lệ lạm phát.*?(\d+[.,]\d+)\s*%"])],
}

EXPORT_PRODUCTS = ["may mặc", "dệt may", "giày dép", "da giày", "điện tử", "linh kiện điện tử", "thiết bị điện tử", "gỗ", "đồ gỗ", "nội thất",
                   "thủy sản", "tôm", "cá", "rau quả", "hoa quả", "cà phê", "cao su", "gạo", "xe máy", "ô tô", "phụ tùng"]
EXPORT_MARKETS = ["Trung Quốc", "Mỹ", "Hoa Kỳ", "Nhật Bản", "Hàn Quốc", "EU", "Châu Âu", "ASEAN", "Đông Nam Á", "Đài Loan", "Hồng Kông", "Singapore", "Thái Lan"]

# Social indicators: (indicator, field, pattern); a second group is the unit.
SOCIAL = [
    ("climate_resilience", "flood_risk_score", r"(?:rủi ro|nguy cơ)\s*lũ[:\s]+(\d+[.,]?\d*)"),
    ("climate_resilience", "green_coverage_pct", r"(?:tỷ lệ|tỉ lệ)\s*(?:che phủ|phủ xanh|rừng)[:\s]+(\d+[.,]?\d*)\s*%"),
    ("climate_resilience", "adaptation_investment_billion", r"(?:đầu tư|vốn)\s*(?:thích ứng|phòng chống)[:\s]+(\d+(?:[.,]\d+)?)\s*tỷ"),
    ("waste_management", "waste_collection_rate", r"(?:tỷ lệ|tỉ lệ)\s*thu gom[:\s]+(\d+[.,]?\d*)\s*%"),
    ("waste_management", "waste_treatment_rate", r"(?:tỷ lệ|tỉ lệ)\s*xử lý[:\s]+(\d+[.,]?\d*)\s*%"),
    ("waste_management", "recycling_rate", r"(?:tỷ lệ|tỉ lệ)\s*tái chế[:\s]+(\d+[.,]?\d*)\s*%"),
    ("waste_management", "total_waste_tons", r"(\d+(?:[.,]\d+)?)\s*(?:tấn|nghìn tấn)\s*(?:rác|chất thải)"),
    ("waste_management", "wastewater_treatment_rate", r"(?:tỷ lệ|tỉ lệ)\s*xử lý\s*nước thải[:\s]+(\d+[.,]?\d*)\s*%"),
    ("hdi", "hdi_score", r"(?:HDI|chỉ số\s*(?:HDI|phát triển\s*con người))[:\s]*(?:đạt|đo|ông)?[:\s]*(\d+[.,]?\d*)"),
    ("hdi", "life_expectancy", r"tuổi thọ\s*(?:trung bình)?[:\s]*(?:đạt|là)?[:\s]*(\d+[.,]?\d*)\s*(?:tuổi|năm)"),
    ("hdi", "expected_schooling_years", r"(?:số năm học|năm đi học)?\s*kỳ vọng[:\s]*(?:đạt|là)?[:\s]*(\d+[.,]?\d*)\s*năm"),
    ("hdi", "gni_per_capita", r"(?:thu nhập|GNI|thu nhập đầu người|thu nhập bình quân)[:\s]*(?:đạt|là)?[:\s]*(\d+(?:[.,]\d+)?)\s*(?:USD|đô la|dollar)"),
    ("social_security_coverage", "coverage_rate", r"(?:tỷ lệ|tỉ lệ)\s*(?:bao phủ|tham gia)\s*(?:an sinh|BHXH)[:\s]+(\d+[.,]?\d*)\s*%"),
    ("social_security_coverage", "health_insurance_coverage", r"(?:tỷ lệ|tỉ lệ)\s*(?:bao phủ|tham gia)\s*(?:BHYT|bảo hiểm y tế)[:\s]+(\d+[.,]?\d*)\s*%"),
    ("social_security_coverage", "social_insurance_coverage", r"(?:tỷ lệ|tỉ lệ)\s*(?:bao phủ|tham gia)\s*(?:BHXH|bảo hiểm xã hội)[:\s]+(\d+[.,]?\d*)\s*%"),
    ("social_security_coverage", "beneficiaries_count", r"(\d+(?:[.,]\d+)?)\s*(?:người|lao động)\s*(?:tham gia|thụ hưởng)"),
    ("social_budget", "social_budget_pct", r"(?:tỷ lệ|tỉ lệ|tỷ trọng)\s*chi\s*(?:an sinh|xã hội)[:\s]+(\d+[.,]?\d*)\s*%"),
    ("social_budget", "total_social_budget_billion", r"chi\s*(?:an sinh|xã hội)[:\s]+(\d+(?:[.,]\d+)?)\s*tỷ"),
    ("social_budget", "poverty_reduction_billion", r"chi\s*(?:giảm nghèo|xóa đói)[:\s]+(\d+(?:[.,]\d+)?)\s*tỷ"),
    ("social_budget", "budget_execution_rate", r"(?:tỷ lệ|tỉ lệ)\s*giải ngân[:\s]+(\d+[.,]?\d*)\s*%"),
    ("security", "drug_cases", r"(?:Hưng\s*Yên|toàn\s*tỉnh|địa\s*bàn)(?:(?!cả\s*nước|toàn\s*quốc).){0,300}?(?:phát\s*hiện|bắt\s*giữ|xử\s*lý|triệt\s*phá|phá)[\s\S]{0,100}?(\d{2,4})\s*vụ[\s\S]{0,50}?(?:ma\s*túy|vi\s*phạm)"),
    ("security", "crime_reduction_rate", r"(?:Hưng\s*Yên|toàn\s*tỉnh|địa\s*bàn)(?:(?!cả\s*nước|toàn\s*quốc).){0,300}?(?:tội\s*phạm|vụ\s*án)[\s\S]{0,100}?giảm[\s\S]{0,50}?(\d{1,2})\s*%"),
    ("egovernment", "online_services_count", r"(\d+)\s*dịch vụ\s*(?:công)?\s*trực tuyến"),
    ("egovernment", "level_4_services_count", r"(\d+)\s*(?:dịch vụ|DVCTT)\s*mức độ 4"),
    ("egovernment", "online_transaction_rate", r"(?:tỷ lệ|tỉ lệ)\s*(?:giao dịch|hồ sơ)\s*trực tuyến[:\s]+(\d+[.,]?\d*)\s*%"),
    ("egovernment", "digital_document_rate", r"(?:tỷ lệ|tỉ lệ)\s*(?:số hóa|điện tử hóa)[:\s]+(\d+[.,]?\d*)\s*%"),
    ("health_statistics", "bhyt_coverage_rate", r"(?:tỷ lệ|tỉ lệ|tỷ suất)\s*(?:bao phủ|tham gia|người có)\s*(?:BHYT|bảo hiểm y tế)[:\s]*(?:đạt)?[:\s]*(\d+[.,]?\d*)\s*%"),
    ("health_statistics", "total_insured", r"(?:có|gồm)?[\s]*(\d+[.,]?\d*)\s*(nghìn|ngàn|triệu)?\s*(?:người|thẻ|hộ)\s*(?:có|tham gia|được cấp|đang tham gia)\s*(?:BHYT|bảo hiểm y tế)"),
    ("health_statistics", "voluntary_insured", r"(\d+[.,]?\d*)\s*(nghìn|ngàn|triệu)?\s*(?:người|hộ|thẻ)\s*(?:tham gia)?\s*(?:BHYT)?\s*tự nguyện"),
    ("health_statistics", "natural_population_growth_rate", r"(?:tốc độ|tỷ lệ)\s*tăng\s*dân số\s*(?:tự nhiên)?[:\s]*(?:là|đạt)?[:\s]*(\d+[.,]?\d*)\s*(?:%|‰)"),
    ("haq_index", "hospital_beds_per_10k", r"(\d+[.,]?\d*)\s*giường\s*(?:bệnh)?[/\s]*(?:trên|cho)?[/\s]*(?:vạn|10[.,]?000|mười nghìn)\s*dân"),
    ("haq_index", "doctors_per_10k", r"(\d+[.,]?\d*)\s*bác sĩ[/\s]*(?:trên|cho)?[/\s]*(?:vạn|10[.,]?000|mười nghìn)\s*dân"),
    ("haq_index", "nurses_per_10k", r"(\d+[.,]?\d*)\s*(?:điều dưỡng|y tá)[/\s]*(?:trên|cho)?[/\s]*(?:vạn|10[.,]?000|mười nghìn)\s*dân"),
    ("tvet_employment", "employment_rate", r"(?:tỷ lệ|tỉ lệ)\s*(?:có việc làm|việc làm)[:\s]+(\d+[.,]?\d*)\s*%"),
    ("tvet_employment", "total_graduates", r"(\d+(?:[.,]\d+)?)\s*(?:học viên|sinh viên)\s*tốt nghiệp"),
    ("tvet_employment", "tvet_enrollment", r"tuyển sinh[:\s]+(\d+(?:[.,]\d+)?)\s*(?:học viên|người|chỉ tiêu)"),
    ("tvet_employment", "tvet_facilities", r"(\d+)\s*(?:cơ sở|trường)\s*(?:GDNN|đào tạo nghề)"),
]
