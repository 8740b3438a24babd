"""Entity patterns (fixed values); letters are Unicode classes instead of listed characters."""

TITLES = [
    "Ông|Bà|Anh|Chị|Cô|Chú|Bác|Dì|Cậu|Mợ",
    "Đồng chí|Đ/c|GS|PGS|TS|ThS|BS|KS|CN",
    "Giáo sư|Phó giáo sư|Tiến sĩ|Thạc sĩ|Bác sĩ|Kỹ sư",
    "Chủ tịch|Phó chủ tịch|Bí thư|Phó bí thư",
    "Giám đốc|Phó giám đốc|Tổng giám đốc",
    "Trưởng phòng|Phó phòng|Trưởng ban|Phó ban",
]
NAME = r"\p{Lu}\p{Ll}+(?:\s+\p{Lu}\p{Ll}+){1,5}"

# (leading words, optional legal form, longest tail)
ORGANISATIONS = [
    ("Công ty|Cty|CT", "TNHH|CP|Cổ phần|Trách nhiệm hữu hạn", 50),
    ("Tập đoàn|Tổng công ty", None, 50),
    ("Ngân hàng|NH", "TMCP|thương mại cổ phần", 40),
    ("Trường|Trường Đại học|ĐH|Học viện", None, 50),
    ("Bệnh viện|BV", None, 40),
    ("Sở|Ban|Ủy ban|UBND|HĐND", None, 50),
    ("Bộ|Cục|Vụ|Viện", None, 50),
]
PARTY = r"(?:Đảng ủy|Chi bộ|Đảng bộ)\s+[^.,;!?\n]{2,50}"

# (leading words, first letters, shortest tail, longest tail)
PLACES = [
    ("tỉnh|Tỉnh", r"\p{Lu}", 2, 30),
    ("thành phố|TP|Thành phố", r"\p{Lu}", 2, 30),
    ("huyện|Huyện", r"\p{Lu}", 2, 30),
    ("xã|Xã|phường|Phường|thị trấn|Thị trấn", r"\p{Lu}", 2, 30),
    ("quận|Quận", r"\p{Lu}0-9", 0, 20),
]

DATES = [
    r"(?:ngày|Ngày)\s+\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
    r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
    r"(?:ngày|Ngày)\s+\d{1,2}\s+(?:tháng|thg)\s+\d{1,2}(?:\s+(?:năm)?\s*\d{2,4})?",
    r"(?:tháng|Tháng)\s+\d{1,2}[/-]\d{2,4}",
    r"(?:năm|Năm)\s+\d{4}",
    r"(?:quý|Quý)\s+[IVX1-4]+[/-]?\d{4}",
]

MONEY = [
    r"\d+(?:[.,]\d{3})*\s*(?:tỷ|triệu|nghìn|ngàn|đồng|VNĐ|USD|EUR)",
    r"\d+(?:[.,]\d+)?\s*(?:tỷ đồng|triệu đồng|nghìn đồng)",
]


def patterns() -> list[tuple[str, str]]:
    """(type, pattern) in the order in which entities are reported."""
    out = [("PERSON", rf"(?:{t})\s+{NAME}") for t in TITLES]
    for lead, form, tail in ORGANISATIONS:
        legal = rf"(?:{form})?\s*" if form else ""
        out.append(("ORG", rf"(?:{lead})\s+{legal}\p{{Lu}}[^.,;!?\n]{{2,{tail}}}"))
    out.append(("ORG", PARTY))
    out += [("LOCATION", rf"(?:{lead})\s+[{first}][\p{{Ll}}\s]{{{low},{high}}}") for lead, first, low, high in PLACES]
    out += [("DATE", p) for p in DATES] + [("MONEY", p) for p in MONEY]
    return out
