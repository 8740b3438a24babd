"""Word lists and lookup tables.

Fixed values: they decide results, so they are stated as they are. Every list
is only the default of a parameter; jobs may pass their own.
"""

# Stopwords of the standard cleaner (fixed values).
CLEANER_STOPWORDS = """
và của có được trong là các với theo này
cho từ để những đã một về được người tại
bị không khi thì vào ra như còn bởi lại
đến ở sau trên đang sẽ làm nên nếu bằng
rằng đây đó nữa nhiều hay mà cả nó họ
ai gì đâu sao thế vì nào đều rất cũng
chỉ nhưng nào giữa trước đi việc nay mỗi
""".split()

# Stopwords of the configurable cleaner (fixed values); `lại` and `ở` are two words.
ENHANCED_STOPWORDS = """
và của có được là các trong cho với
này đó để từ về theo như hay hoặc
tại bởi do vì nên mà nhưng khi nếu
thì cũng rằng đã chưa nữa ra vào lại
ở thì là đến đi nói biết muốn phải
""".split()

# Stopwords of the topic tokenizer (fixed values).
TOKENIZER_STOPWORDS = """
và của cho với từ trong trên dưới sau trước
khi nếu thì là có được bị sẽ đã đang
mà nhưng hoặc nên để vì do bởi theo về
này đó kia đây đâu nào sao thế vậy
tôi bạn anh chị em chúng họ mình ta người
cái con chiếc bài việc điều nơi lúc thời
rất quá lắm nhất hơn kém bằng với như
một hai ba bốn năm sáu bảy tám chín mười
nhiều ít mỗi mọi các những mấy
không chưa chẳng chả đừng
ở tại vào ra lên xuống qua lại
cũng cùng vẫn đều mới còn chỉ vừa
phải cần
""".split()

# Stopwords of the keyword counters (fixed values).
KEYWORD_STOPWORDS = """
và của là có được cho với trong này đã
các những một không người để theo về từ
đến như tại khi sau trên ra còn nhiều
cũng nhưng hay hoặc nếu thì mà vì nên
rằng bị do sẽ đang vào lại năm ngày
việc làm nào hơn rất quá đây đó ai
gì sao thế bao mấy đâu lúc giờ chỉ
""".split()

# Stopwords of the TF-IDF phrase scorer (fixed values).
PHRASE_STOPWORDS = """
của và có được này cho từ với theo tại
trong các một là để đã không về người
khi như nên cũng đang sẽ bị do vào ra
còn mà thì đó nó họ này ấy
""".split()

# Stopwords of the class-based and the counting phrase scorers (fixed values).
CLASS_PHRASE_STOPWORDS = """
của và có được này cho từ với theo tại
trong các một là để đã không về người
""".split()

# Words trimmed from either end of a phrase (fixed values).
PHRASE_EDGE_WORDS = "của và có được này cho từ với theo tại trong các".split()

# Abbreviations and chat words (fixed values).
ABBREVIATIONS = {
    "k": "không", "ko": "không", "hok": "không", "hem": "không",
    "dc": "được", "đc": "được", "vs": "với", "j": "gì",
    "h": "giờ", "r": "rồi", "cx": "cũng", "ntn": "như thế nào",
    "tn": "Việt Nam", "vn": "Việt Nam",
    "tp": "thành phố", "tphcm": "thành phố hồ chí minh", "tp.hcm": "thành phố hồ chí minh",
    "hn": "hà nội", "đhqg": "đại học quốc gia", "ubnd": "ủy ban nhân dân",
    "ubmttq": "ủy ban mặt trận tổ quốc", "bch": "ban chấp hành",
    "btt": "bí thư", "ct": "chủ tịch", "ttu": "thường trực",
    "ttp": "thành phố", "tx": "thị xã", "tt": "thị trấn",
}

# Misplaced diacritics, applied in this order (fixed values).
DIACRITIC_FIXES = {
    "hoà": "hòa", "hòan": "hoàn", "dùn": "dùng", "tìn": "tìm",
    "thơì": "thời", "giơì": "giời", "ngươì": "người",
}

# Social hosts (fixed values); matched as host or as parent domain of the host.
PLATFORM_HOSTS = {
    "facebook.com": "facebook", "fb.com": "facebook",
    "youtube.com": "youtube", "youtu.be": "youtube",
    "tiktok.com": "tiktok",
    "twitter.com": "twitter", "x.com": "twitter", "t.co": "twitter",
    "instagram.com": "instagram", "instagr.am": "instagram",
    "zalo.me": "zalo", "linkedin.com": "linkedin", "threads.net": "threads",
}

# Source aliases (fixed values).
SOURCE_ALIASES = {
    "facebook": "facebook", "fb": "facebook", "youtube": "youtube", "yt": "youtube",
    "tiktok": "tiktok", "twitter": "twitter", "instagram": "instagram",
    "web": "web", "news": "web", "rss": "rss", "api": "api",
}

# Domain of a platform whose url is unknown (fixed values).
PLATFORM_DOMAINS = {
    "facebook": "facebook.com", "youtube": "youtube.com", "tiktok": "tiktok.com",
    "twitter": "twitter.com", "instagram": "instagram.com", "threads": "threads.net",
}

# Source names that imply a domain; the first contained name wins (fixed values).
SOURCE_NAME_DOMAINS = [
    ("vnexpress", "vnexpress.net"), ("vn express", "vnexpress.net"),
    ("tuổi trẻ", "tuoitre.vn"), ("tuoi tre", "tuoitre.vn"),
    ("thanh niên", "thanhnien.vn"), ("thanh nien", "thanhnien.vn"),
    ("dân trí", "dantri.com.vn"), ("dan tri", "dantri.com.vn"),
    ("vietnamnet", "vietnamnet.vn"), ("viet nam net", "vietnamnet.vn"),
    ("báo mới", "baomoi.com"), ("bao moi", "baomoi.com"),
    ("zing news", "zingnews.vn"), ("zingnews", "zingnews.vn"),
    ("kenh14", "kenh14.vn"), ("soha", "soha.vn"), ("genk", "genk.vn"), ("2sao", "2sao.vn"),
    ("cafef", "cafef.vn"), ("cafebiz", "cafebiz.vn"), ("vietstock", "vietstock.vn"), ("ndh", "ndh.vn"),
    ("nhandan", "nhandan.vn"), ("nhân dân", "nhandan.vn"), ("vov", "vov.vn"), ("vtv", "vtv.vn"),
    ("báo hưng yên", "baohungyen.vn"), ("bao hung yen", "baohungyen.vn"),
    ("hưng yên", "baohungyen.vn"), ("hung yen", "baohungyen.vn"), ("baohungyen", "baohungyen.vn"),
]

# Account-type synonyms (fixed values).
ACCOUNT_TYPES = {
    "fanpage": "page", "fan page": "page", "công khai": "profile", "group": "group", "nhóm": "group",
}

# Province spellings (fixed values).
PROVINCE_NAMES = {
    "hà nội": "Hà Nội", "ha noi": "Hà Nội", "hn": "Hà Nội",
    "tp hcm": "Hồ Chí Minh", "hcm": "Hồ Chí Minh", "sài gòn": "Hồ Chí Minh",
    "saigon": "Hồ Chí Minh", "tp.hcm": "Hồ Chí Minh",
    "đà nẵng": "Đà Nẵng", "da nang": "Đà Nẵng",
    "hưng yên": "Hưng Yên", "hung yen": "Hưng Yên",
}

# Provinces of the location gazetteer (fixed values).
PROVINCES = [
    "Hà Nội", "Hồ Chí Minh", "Đà Nẵng", "Hải Phòng", "Cần Thơ",
    "An Giang", "Bà Rịa - Vũng Tàu", "Bắc Giang", "Bắc Kạn", "Bạc Liêu",
    "Bắc Ninh", "Bến Tre", "Bình Định", "Bình Dương", "Bình Phước",
    "Bình Thuận", "Cà Mau", "Cao Bằng", "Đắk Lắk", "Đắk Nông",
    "Điện Biên", "Đồng Nai", "Đồng Tháp", "Gia Lai", "Hà Giang",
    "Hà Nam", "Hà Tĩnh", "Hải Dương", "Hậu Giang", "Hòa Bình",
    "Hưng Yên", "Khánh Hòa", "Kiên Giang", "Kon Tum", "Lai Châu",
    "Lâm Đồng", "Lạng Sơn", "Lào Cai", "Long An", "Nam Định",
    "Nghệ An", "Ninh Bình", "Ninh Thuận", "Phú Thọ", "Phú Yên",
    "Quảng Bình", "Quảng Nam", "Quảng Ngãi", "Quảng Ninh", "Quảng Trị",
    "Sóc Trăng", "Sơn La", "Tây Ninh", "Thái Bình", "Thái Nguyên",
    "Thanh Hóa", "Thừa Thiên Huế", "Tiền Giang", "Trà Vinh", "Tuyên Quang",
    "Vĩnh Long", "Vĩnh Phúc", "Yên Bái",
]

# Named entities kept whole by the phrase scorers (fixed values).
ENTITIES = [
    "hưng yên", "phố hiến", "khoái châu", "văn lâm", "văn giang", "yên mỹ",
    "mỹ hào", "ân thi", "kim động", "tiên lữ", "phù cừ",
    "hà nội", "hải phòng", "thái bình", "hải dương", "bắc ninh", "bắc giang",
    "nam định", "ninh bình", "hà nam", "vĩnh phúc", "quảng ninh",
    "việt nam", "trung quốc", "đông nam á",
    "ubnd", "ủy ban nhân dân", "bộ giao thông vận tải", "bộ xây dựng",
    "bộ kế hoạch và đầu tư", "quốc hội", "chính phủ", "tỉnh ủy", "thành ủy",
    "công an", "bệnh viện", "trường đại học",
    "chùa dâu", "đền triều", "phủ giầy", "lăng mộ", "di tích lịch sử",
    "khu di tích", "bảo tàng", "nhà thờ",
]

# Phrases of hot events, boosted in keyword statistics (fixed values).
HOT_EVENTS = [
    "tai nạn", "cháy", "vụ án", "bắt giữ", "triệt phá", "phá án",
    "sập", "đổ", "lũ lụt", "bão", "động đất", "dịch bệnh",
    "biểu tình", "đình công", "tham nhũng", "kỷ luật", "bổ nhiệm",
    "bầu cử", "họp quốc hội", "nghị quyết", "chỉ thị",
    "tăng giá", "giảm giá", "lạm phát", "tỷ giá", "chứng khoán",
    "bất động sản", "đấu giá", "phá sản", "nợ xấu",
    "ma túy", "cờ bạc", "lừa đảo", "trộm cắp", "cướp",
    "buôn lậu", "đường dây", "ổ nhóm", "băng nhóm",
    "kẹt xe", "ùn tắc", "tai nạn giao thông", "csgt", "phạt nguội",
    "scandal", "ly hôn", "kết hôn", "qua đời", "nhập viện",
]

# Fragments that disqualify a keyword (fixed values).
KEYWORD_GARBAGE = [
    "translate", "http", "www", "created", ".com", ".vn", "facebook.com",
    "khiến", "khoảng", "hôm nay", "tối qua", "thật sự", "thời gian",
]
