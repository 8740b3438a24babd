"""Default emotion lexicon and category dictionary.

Fixed values, given as a starter set per emotion and category. Complete
dictionaries are data: pass them as tables of the same shape (see
``emotion_table`` and ``category_table``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# emotion: (group, weight) in tie-break order (fixed values).
EMOTIONS = {
    "vui_mừng": ("positive", 1.0), "ủng_hộ": ("positive", 1.0), "tin_tưởng": ("positive", 1.0),
    "hài_lòng": ("positive", 1.0), "tự_hào": ("positive", 1.2), "hy_vọng": ("positive", 1.0),
    "phẫn_nộ": ("negative", 1.3), "lo_ngại": ("negative", 1.2), "thất_vọng": ("negative", 1.0),
    "chỉ_trích": ("negative", 0.8), "buồn_bã": ("negative", 1.0), "sợ_hãi": ("negative", 1.2),
    "trung_lập": ("neutral", 0.5), "hoài_nghi": ("neutral", 0.8), "ngạc_nhiên": ("neutral", 0.7),
}

# Starter terms per emotion (fixed values).
EMOTION_TERMS = {
    "vui_mừng": ["vui", "vui vẻ", "vui mừng", "hạnh phúc", "phấn khởi", "cười", "lạc quan", "chúc mừng", "lễ hội", "thắng lợi"],
    "ủng_hộ": ["ủng hộ", "đồng ý", "đồng tình", "tán thành", "chia sẻ", "khuyến khích", "động viên", "công nhận", "đánh giá cao", "ghi nhận"],
    "tin_tưởng": ["tin tưởng", "tin cậy", "minh bạch", "rõ ràng", "công khai", "chính xác", "uy tín", "cam kết", "bảo đảm", "chắc chắn"],
    "hài_lòng": ["hài lòng", "đáp ứng", "tốt", "hay", "đẹp", "chất lượng", "hiệu quả", "tuyệt vời", "xuất sắc", "nổi bật", "khá", "ổn", "được"],
    "tự_hào": ["tự hào", "vinh dự", "thành tựu", "danh hiệu", "kỷ lục", "huy chương", "giải thưởng", "vô địch", "anh hùng", "tiên phong"],
    "hy_vọng": ["hy vọng", "kỳ vọng", "mong đợi", "triển vọng", "cơ hội", "tiềm năng", "phát triển", "tiến bộ", "cải thiện", "nâng cao", "đổi mới"],
    "phẫn_nộ": ["phẫn nộ", "tức giận", "giận dữ", "bức xúc", "phản đối", "lên án", "tố cáo", "bất bình", "bất mãn", "quá đáng"],
    "lo_ngại": ["lo ngại", "lo lắng", "quan ngại", "bất an", "hoang mang", "căng thẳng", "áp lực", "nguy cơ", "rủi ro", "khủng hoảng", "cảnh báo", "nghiêm trọng"],
    "thất_vọng": ["thất vọng", "chán nản", "thất bại", "không như kỳ vọng", "kém", "tệ", "dở", "yếu", "thiếu", "suy giảm", "giảm sút"],
    "chỉ_trích": ["chỉ trích", "phê phán", "phê bình", "góp ý", "bác bỏ", "nghi ngờ", "chất vấn", "điều tra", "kiểm tra", "thanh tra"],
    "buồn_bã": ["buồn", "buồn bã", "đau buồn", "tiếc nuối", "thương tiếc", "chia buồn", "cô đơn", "bi thương", "đau lòng", "nước mắt"],
    "sợ_hãi": ["sợ hãi", "sợ", "kinh hoàng", "hoảng sợ", "hoảng loạn", "khủng khiếp", "đáng sợ", "thảm khốc", "bi kịch", "thảm họa"],
    "trung_lập": ["bình thường", "thông báo", "cho biết", "phát biểu", "theo", "cụ thể", "thông tin", "báo cáo", "kết quả", "thống kê", "tổ chức", "thực hiện"],
    "hoài_nghi": ["hoài nghi", "nghi ngờ", "không chắc", "chưa rõ", "mập mờ", "khó nói", "bất ngờ", "kỳ lạ", "mơ hồ", "phân vân"],
    "ngạc_nhiên": ["ngạc nhiên", "bất ngờ", "sửng sốt", "kinh ngạc", "choáng", "không ngờ", "đột ngột", "lạ", "lần đầu", "chưa từng", "độc đáo"],
}

# Words that change the weight of the next token (fixed values).
NEGATIONS = ["không", "chưa", "chẳng", "đừng", "chả"]
INTENSIFIERS = ["rất", "quá", "siêu"]
DIMINISHERS = ["hơi", "khá"]

# Starter keywords per category, in tie-break order (fixed values).
CATEGORY_KEYWORDS = {
    "giao_duc": ["giáo dục", "học sinh", "sinh viên", "trường học", "đại học", "tiểu học", "giáo viên", "kỳ thi", "tuyển sinh", "học phí", "học bổng", "đào tạo", "giảng viên"],
    "y_te": ["y tế", "bệnh viện", "bác sĩ", "bệnh nhân", "khám bệnh", "thuốc", "vaccine", "dịch bệnh", "covid", "ung thư", "sức khỏe", "bảo hiểm y tế", "điều trị"],
    "giao_thong": ["giao thông", "đường bộ", "hàng không", "tai nạn", "xe máy", "ô tô", "xe buýt", "cao tốc", "quốc lộ", "cầu", "ùn tắc", "csgt", "sân bay", "vận tải"],
    "hanh_chinh_cong": ["hành chính", "thủ tục", "giấy tờ", "căn cước", "đăng ký", "ubnd", "ủy ban", "chính quyền", "công chức", "dịch vụ công", "một cửa", "chuyển đổi số", "cải cách"],
    "kinh_te": ["kinh tế", "tài chính", "ngân hàng", "chứng khoán", "lãi suất", "tỷ giá", "bất động sản", "doanh nghiệp", "đầu tư", "thuế", "xuất khẩu", "fdi", "gdp", "thị trường"],
    "moi_truong": ["môi trường", "ô nhiễm", "khí thải", "nước thải", "rác thải", "biến đổi khí hậu", "thiên tai", "lũ lụt", "hạn hán", "bão", "rừng", "bụi mịn", "pm2.5", "aqi"],
    "an_ninh_phap_luat": ["công an", "cảnh sát", "an ninh", "tội phạm", "bắt giữ", "điều tra", "khởi tố", "tòa án", "luật sư", "tham nhũng", "lừa đảo", "ma túy", "luật", "nghị định"],
    "xa_hoi": ["xã hội", "đời sống", "cộng đồng", "từ thiện", "hộ nghèo", "an sinh", "trợ cấp", "trẻ em", "phụ nữ", "lao động", "công nhân", "nông dân", "nhà ở"],
    "van_hoa_giai_tri": ["văn hóa", "nghệ thuật", "âm nhạc", "ca sĩ", "diễn viên", "phim", "truyền hình", "lễ hội", "du lịch", "di sản", "bảo tàng", "sách", "thể thao", "bóng đá"],
    "cong_nghe": ["công nghệ", "internet", "mạng", "5g", "smartphone", "phần mềm", "ứng dụng", "ai", "trí tuệ nhân tạo", "blockchain", "facebook", "google", "tiktok", "mạng xã hội"],
    "quoc_te": ["quốc tế", "thế giới", "toàn cầu", "nước ngoài", "liên hợp quốc", "mỹ", "trung quốc", "nga", "nhật bản", "asean", "ngoại giao", "hiệp định", "chiến tranh", "xung đột"],
}

# Category to field routing (fixed values).
CATEGORY_FIELDS = {
    "medical": "y_te", "education": "giao_duc", "transportation": "ha_tang_giao_thong", "environment": "moi_truong", "policy": "an_sinh_xa_hoi",
    "security": "an_ninh_trat_tu", "management": "hanh_chinh_cong", "politics": "xay_dung_dang", "society": "van_hoa_the_thao",
}


def emotion_table(spark: SparkSession, terms: dict[str, list[str]] | None = None,
                  emotions: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """(rank, emotion, group, weight, words array, phrases array)."""
    terms, emotions = terms or EMOTION_TERMS, emotions or EMOTIONS
    rows = [
        (i, e, g, float(w), [t for t in terms.get(e, []) if " " not in t], [t for t in terms.get(e, []) if " " in t])
        for i, (e, (g, w)) in enumerate(emotions.items())
    ]
    return spark.createDataFrame(
        rows, "rank int, emotion string, group string, weight double, words array<string>, phrases array<string>")


def category_table(spark: SparkSession, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """(rank, category, keywords array)."""
    rows = [(i, c, list(k)) for i, (c, k) in enumerate((keywords or CATEGORY_KEYWORDS).items())]
    return spark.createDataFrame(rows, "rank int, category string, keywords array<string>")
