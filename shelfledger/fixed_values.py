"""Word lists, tables, patterns and formats that results must agree on.

Everything here is data.  The jobs take these as defaults and accept other values, so a deployment can read its own
tables with ``sources.rules`` instead.
"""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

# --- fixed values: retail chains -------------------------------------------------------------------------------------


class Chain(NamedTuple):
    name: str
    slug: str
    code: str
    label: str
    domain: str


CHAINS = [
    Chain("TGDD", "tgdd", "tgdd", "MW", "thegioididong.com"),
    Chain("CellphoneS", "cellphones", "cps", "CPS", "cellphones.com.vn"),
    Chain("Viettel Store", "viettel", "vt", "VIETTEL", "viettelstore.vn"),
    Chain("FPT Shop", "fpt", "fpt", "FPT", "fptshop.com.vn"),
    Chain("Phong Vũ", "phongvu", "pv", "PV", "phongvu.vn"),
]
CHAIN_NAMES = [c.name for c in CHAINS]

# --- fixed values: calendar ------------------------------------------------------------------------------------------

BUSINESS_ZONE = "Asia/Ho_Chi_Minh"
FISCAL_ANCHOR_WEEK = "2026-09-28"
FISCAL_ANCHOR_YEAR = 27
WEEKS_PER_QUARTER = 13
WEEKS_PER_YEAR = 52

# --- fixed values: statuses, prices, limits --------------------------------------------------------------------------

STATUS_PREFIX = "[Tình trạng] "
PRICE_SEEN = "Đã ghi nhận giá hiển thị"
NO_DATA = "Chưa có dữ liệu"
MIN_VND, MAX_VND = 10_000, 500_000_000
SHOCK_PERCENT, SHOCK_AMOUNT = 3, 500_000
MAX_URLS_PER_CHANNEL = 20
MAX_RULES = 200
CATALOG_MAX_AGE_DAYS = 8
FUTURE_TOLERANCE_MINUTES = 5
SOURCE_LIMITS = {"max_pages": (1, 50), "max_candidates": (1, 1000), "scroll_rounds": (1, 30)}
LISTING_SHARE = {"TGDD": 80}  # percent of the published total; every other chain must match it exactly

HOT_PROMO = r"vnpay|thu cũ|đổi mới|quà|tặng|voucher|hoàn tiền|giảm thêm"

STATUS_CODES = {
    "ngung_kinh_doanh": "Ngừng kinh doanh",
    "het_hang": "Hết hàng",
    "tam_het_hang": "Tạm hết hàng",
    "dat_truoc": "Đặt trước",
}
STATUS_PHRASES = ["hết hàng", "ngừng kinh doanh", "ngừng bán", "tạm hết", "đặt trước", "liên hệ"]

# --- fixed values: error classes, first match wins -------------------------------------------------------------------

TECHNICAL_PREFIX = "Lỗi kỹ thuật"
ERROR_KINDS = [
    ("blocked", r"HTTP (401|403)\b|bị chặn|forbidden"),
    ("rate_limited", r"HTTP 429|giới hạn tốc độ"),
    ("robots", r"robots\.txt"),
    ("http_error", r"HTTP \d{3}"),
    ("network", r"lỗi mạng|không phản hồi|Timeout|TransportError"),
    ("out_of_stock", r"hết hàng|không bán|ngừng kinh doanh|không đặt mua"),
    ("preorder", r"đặt trước"),
    ("variant_changed", r"biến thể|SKU khác|màu đã khóa|khám phá lại|ERP"),
    ("incomplete_listing", r"thẻ|thiếu|max_candidates|phân trang|Xem thêm|tổng"),
    ("no_price_data", r"không có dữ liệu giá|giao diện cũ|chưa mở bán"),
    ("structure_changed", r"cấu trúc|contract|JSON|không tìm thấy khối|server-render"),
    ("out_of_scope", r"ngoài phạm vi"),
]
ACCESS_ERRORS = ["blocked", "rate_limited", "robots", "http_error", "network"]
LINK_CHECK_KINDS = [
    ("wrong_model", r"model (?:trên trang|con/cha) (?:khác|không đúng)|không đúng model|sai model"),
    ("color_not_found", r"chưa xác minh được (?:một lựa chọn )?màu|màu yêu cầu"),
]

# --- fixed values: categories and brands -----------------------------------------------------------------------------

PHONE, TABLET, LAPTOP, WATCH, EARBUDS = (
    "Điện thoại", "Máy tính bảng", "Máy tính xách tay", "Đồng hồ thông minh", "AirPods")
CATEGORIES = [PHONE, TABLET, LAPTOP, WATCH, EARBUDS]
UNKNOWN_CATEGORY = "Chưa phân loại"
UNKNOWN_BRAND = "Chưa xác định"
CATEGORY_TOKENS = [
    (EARBUDS, r"\bairpods\b"),
    (TABLET, r"\b(ipad|tablet|galaxy tab|xiaomi pad|oppo pad)\b"),
    (WATCH, r"\b(apple watch|galaxy watch|smartwatch|đồng hồ)\b"),
    (LAPTOP, r"\b(macbook|laptop|máy tính xách tay)\b"),
    (PHONE, r"\b(iphone|điện thoại|smartphone)\b"),
]
BRAND_ALIASES = {
    "apple": "Apple", "iphone": "Apple", "ipad": "Apple", "macbook": "Apple", "airpods": "Apple",
    "samsung": "Samsung", "xiaomi": "Xiaomi", "redmi": "Xiaomi", "poco": "Xiaomi", "oppo": "OPPO",
    "asus": "Asus", "hp": "HP", "dell": "Dell", "lenovo": "Lenovo", "huawei": "Huawei", "garmin": "Garmin",
    "acer": "Acer", "msi": "MSI",
}
BRAND_TOKENS = [
    ("Apple", r"\b(apple|iphone|ipad|macbook|airpods)\b"),
    ("Samsung", r"\b(samsung|galaxy)\b"),
    ("Xiaomi", r"\b(xiaomi|redmi|poco)\b"),
]
BRAND_NAMED = r"\b(oppo|asus|hp|dell|lenovo|huawei|garmin|acer|msi)\b"
BRAND_SCOPE = ["Apple"]

# --- fixed values: scope words ---------------------------------------------------------------------------------------

NOT_NEW = (r"(?<![a-zà-ỹ])(cũ|đã kích hoạt|đã qua sử dụng|like\s*new|refurbished|renew|trưng bày|"
           r"xách tay|quốc tế|lock|99%|98%|open\s*box|demo)(?![a-zà-ỹ])")
NOT_NEW_PHONE = r"cũ|đã dùng|like\s*new|refurbished|đổi bảo hành|trưng bày|99%|lock|quốc tế|xách tay"
DESKTOPS = r"\b(mac\s*mini|mac\s*studio|imac|mac\s*pro|màn hình|studio display)\b"
NOISE = (r"\b(điện thoại|máy tính bảng|máy tính xách tay|laptop|đồng hồ thông minh|đồng hồ|"
         r"tai nghe(?: bluetooth| không dây| chụp tai| true wireless| chống ồn)*|"
         r"chính hãng(?: apple việt nam| vn/a)?|vn/a|wifi|wi-fi)\b")

# --- fixed values: tracked models (name, pattern) in display order ---------------------------------------------------

MODEL_RULES = [
    ("iPhone 18 Pro Max", r"\biPhone\s+18\s+Pro\s+Max(?!\s+(?:pro|max|plus|mini)\b)\b"),
    ("iPhone 18 Pro", r"\biPhone\s+18\s+Pro(?!\s+(?:pro|max|plus|mini)\b)\b"),
    ("iPhone 17 Pro Max", r"\biPhone\s+17\s+Pro\s+Max(?!\s+(?:pro|max|plus|mini)\b)\b"),
    ("iPhone 17 Pro", r"\biPhone\s+17\s+Pro(?!\s+(?:pro|max|plus|mini)\b)\b"),
    ("iPhone Air", r"\biPhone\s+Air(?!\s+(?:pro|max|plus|mini)\b)\b"),
    ("iPhone 17", r"\biPhone\s+17(?!\s+(?:pro|max|plus|mini)\b)\b"),
    ("iPhone 17e", r"\biPhone\s+17e(?!\s+(?:pro|max|plus|mini)\b)\b"),
    ("iPhone 16 Plus", r"\biPhone\s+16\s+Plus(?!\s+(?:pro|max|plus|mini)\b)\b"),
    ("iPhone 16", r"\biPhone\s+16(?!\s+(?:pro|max|plus|mini)\b)\b"),
    ("iPhone 15 Plus", r"\biPhone\s+15\s+Plus(?!\s+(?:pro|max|plus|mini)\b)\b"),
    ("iPhone 15", r"\biPhone\s+15(?!\s+(?:pro|max|plus|mini)\b)\b"),
    ("iPhone 14", r"\biPhone\s+14(?!\s+(?:pro|max|plus|mini)\b)\b"),
    ("iPhone 13", r"\biPhone\s+13(?!\s+(?:pro|max|plus|mini)\b)\b"),
    ("iPad A16", r"\bipad\b(?!\s+(?:air|pro|mini)\b)(?=[\s\S]*\ba16\b)"),
    ("iPad Air M4 11", r"\bipad\s+Air\b(?=[\s\S]*\bM4\b)(?=[\s\S]*\b11(?:\s*inch)?\b)"),
    ("iPad Air M4 13", r"\bipad\s+Air\b(?=[\s\S]*\bM4\b)(?=[\s\S]*\b13(?:\s*inch)?\b)"),
    ("iPad Pro M5 11", r"\bipad\s+Pro\b(?=[\s\S]*\bM5\b)(?=[\s\S]*\b11(?:\s*inch)?\b)"),
    ("iPad Pro M5 13", r"\bipad\s+Pro\b(?=[\s\S]*\bM5\b)(?=[\s\S]*\b13(?:\s*inch)?\b)"),
    ("iPad Mini 7", r"\biPad\s+Mini\s+7\b"),
    ("iMac", r"\biMac\b"),
    ("Mac Mini", r"\bmac\s*mini\b"),
    ("MacBook Neo", r"\bMacBook\s+Neo\b"),
    ("MacBook Air 13 M5", r"\bmacbook\s+Air\b(?=[\s\S]*\b13(?:\s*inch)?\b)(?=[\s\S]*\bM5(?!\s+(?:pro|max)\b)\b)"),
    ("MacBook Air 15 M5", r"\bmacbook\s+Air\b(?=[\s\S]*\b15(?:\s*inch)?\b)(?=[\s\S]*\bM5(?!\s+(?:pro|max)\b)\b)"),
    ("MacBook Pro 14 M5", r"\bmacbook\s+Pro\b(?=[\s\S]*\b14(?:\s*inch)?\b)(?=[\s\S]*\bM5(?!\s+(?:pro|max)\b)\b)"),
    ("MacBook Pro 16 M5 Pro", r"\bmacbook\s+Pro\b(?=[\s\S]*\b16(?:\s*inch)?\b)(?=[\s\S]*\bM5\s+Pro\b)"),
    ("Apple Watch S11", r"\bapple\s+watch\s+(?:series\s*11|s11)\b"),
    ("Apple Watch SE 3", r"\bApple\s+Watch\s+SE\s+3\b"),
    ("Apple Watch Ultra 3", r"\bApple\s+Watch\s+Ultra\s+3\b"),
    ("AirPods 4", r"\bairpods\s+4\b(?![\s\S]*(?:\banc\b|chống\s+ồn))"),
    ("AirPods 4 with ANC", r"\bairpods\s+4\b(?=[\s\S]*(?:\banc\b|chống\s+ồn))"),
    ("AirPods Pro 3", r"\bAirPods\s+Pro\s+3\b"),
    ("AirPods Max", r"\bairpods\s+max\b(?!\s+\d)"),
    ("AirPods Max 2", r"\bAirPods\s+Max\s+2\b"),
    ("AirPods 5", r"\bairpods\s+5\b(?![\s\S]*(?:sạc\s+(?:không|ko)\s+dây|wireless\s+charging))"),
    ("AirPods 5 sạc ko dây", r"\bairpods\s+5\b(?=[\s\S]*(?:sạc\s+(?:không|ko)\s+dây|wireless\s+charging))"),
]
MODEL_NAMES = [name for name, _ in MODEL_RULES]

# tracked color per model; models that are absent accept every color
MODEL_COLORS = {
    "iPhone 18 Pro Max": "Đỏ Burgundy", "iPhone 18 Pro": "Đỏ Burgundy",
    "iPhone 17 Pro Max": "Cam vũ trụ", "iPhone 17 Pro": "Cam vũ trụ",
    "iPhone Air": "Trắng Mây", "iPhone 17": "Xanh Lá Xô Thôm", "iPhone 17e": "Đen",
    "iPhone 16 Plus": "Đen", "iPhone 16": "Đen", "iPhone 15 Plus": "Hồng", "iPhone 15": "Hồng",
    "iPhone 14": "Đen", "iPhone 13": "Đen", "iPad A16": "Bạc",
    "iPad Air M4 11": "Xám Không Gian", "iPad Air M4 13": "Xám Không Gian",
    "iPad Pro M5 11": "Đen Không Gian", "iPad Pro M5 13": "Đen Không Gian", "iPad Mini 7": "Xám",
    "iMac": "Bạc", "MacBook Neo": "Vàng Citrus",
    "MacBook Air 13 M5": "Xanh Da Trời", "MacBook Air 15 M5": "Xanh Da Trời",
    "MacBook Pro 14 M5": "Đen Không Gian", "MacBook Pro 16 M5 Pro": "Đen Không Gian",
    "Apple Watch S11": "Đen Bóng", "Apple Watch SE 3": "Ánh Sao", "Apple Watch Ultra 3": "Đen",
    "AirPods Max": "Đêm Xanh Thẳm", "AirPods Max 2": "Đêm Xanh Thẳm",
}

# color names a shop prints for a tracked color, per chain slug
SHOP_COLORS = {
    "tgdd": {
        ("iPhone 15", "Hồng"): ["Hồng nhạt"],
        ("iPhone 15 Plus", "Hồng"): ["Hồng nhạt"],
        ("iPhone 17", "Xanh Lá Xô Thôm"): ["Xanh Lá Xô Thơm"],
        ("MacBook Air 13 M5", "Xanh Da Trời"): ["Xanh da trời nhạt"],
        ("MacBook Air 15 M5", "Xanh Da Trời"): ["Xanh da trời nhạt"],
        ("iPad Air M4 11", "Xám Không Gian"): ["Đen - Xám"],
        ("iPad Air M4 13", "Xám Không Gian"): ["Đen - Xám"],
        ("iPad Pro M5 11", "Đen Không Gian"): ["Đen"],
        ("iPad Pro M5 13", "Đen Không Gian"): ["Đen"],
        ("MacBook Pro 14 M5", "Đen Không Gian"): ["Đen"],
        ("MacBook Pro 16 M5 Pro", "Đen Không Gian"): ["Đen"],
        ("Apple Watch SE 3", "Ánh Sao"): ["Trắng Starlight"],
        ("Apple Watch Ultra 3", "Đen"): ["Titan đen"],
        ("iPad Mini 7", "Xám"): ["Đen - Xám"],
        ("AirPods Max", "Đêm Xanh Thẳm"): ["Xanh đen"],
        ("AirPods Max 2", "Đêm Xanh Thẳm"): ["Xanh đen"],
        ("MacBook Neo", "Vàng Citrus"): ["Vàng nhạt"],
    },
    "cellphones": {
        ("iPhone 17", "Xanh Lá Xô Thôm"): ["Xanh Lá Xô Thơm"],
        ("Apple Watch Ultra 3", "Đen"): ["Titan Đen"],
    },
}

# --- fixed values: links ---------------------------------------------------------------------------------------------

TRACKERS = ["fbclid", "gclid", "itm", "ref", "source"]


class Channel(NamedTuple):
    slug: str
    label: str
    hosts: list[str]
    path: str
    query: str | None


LINK_CHANNELS = [
    Channel("tgdd", "MW", ["www.thegioididong.com", "thegioididong.com"],
            r"/(?:dtdd|may-tinh-bang|laptop|dong-ho-thong-minh|tai-nghe)/[a-z0-9-]+", "code"),
    Channel("cellphones", "CPS", ["cellphones.com.vn"], r"/[a-z0-9-]+\.html", "product_id"),
    Channel("fpt", "FPT", ["fptshop.com.vn"], r"/[a-z0-9-]+/[a-z0-9-]+", "sku"),
    Channel("viettel", "Viettel", ["viettelstore.vn"], r"/[a-z0-9/-]*-pid\d+\.html", None),
    Channel("phongvu", "Phong Vũ", ["phongvu.vn"], r"/[a-z0-9-]+--[sp]\d+", "sku"),
]

CATEGORY_URL_PATTERNS = {
    "TGDD": {
        PHONE: r"^https://(?:www\.)?thegioididong\.com/dtdd/[^/?#]+/?(?:\?.*)?$",
        TABLET: r"^https://(?:www\.)?thegioididong\.com/may-tinh-bang/[^/?#]+/?(?:\?.*)?$",
        LAPTOP: r"^https://(?:www\.)?thegioididong\.com/laptop/[^/?#]+/?(?:\?.*)?$",
        WATCH: r"^https://(?:www\.)?thegioididong\.com/dong-ho-thong-minh/[^/?#]+/?(?:\?.*)?$",
        "Airpods": r"^https://(?:www\.)?thegioididong\.com/tai-nghe/[^/?#]+/?(?:\?.*)?$",
    },
    "FPT Shop": {
        PHONE: r"^https://(?:www\.)?fptshop\.com\.vn/dien-thoai/[^/?#]+/?(?:\?.*)?$",
        TABLET: r"^https://(?:www\.)?fptshop\.com\.vn/may-tinh-bang/[^/?#]+/?(?:\?.*)?$",
        LAPTOP: r"^https://(?:www\.)?fptshop\.com\.vn/may-tinh-xach-tay/[^/?#]+/?(?:\?.*)?$",
        WATCH: r"^https://(?:www\.)?fptshop\.com\.vn/smartwatch/[^/?#]+/?(?:\?.*)?$",
        "Airpods": r"^https://(?:www\.)?fptshop\.com\.vn/tai-nghe/[^/?#]+/?(?:\?.*)?$",
    },
    "CellphoneS": {
        PHONE: r"^https://(?:www\.)?cellphones\.com\.vn/[^/?#]+\.html(?:\?.*)?$",
        TABLET: r"^https://(?:www\.)?cellphones\.com\.vn/[^/?#]+\.html(?:\?.*)?$",
        LAPTOP: r"^https://(?:www\.)?cellphones\.com\.vn/[^/?#]+\.html(?:\?.*)?$",
        WATCH: r"^https://(?:www\.)?cellphones\.com\.vn/[^/?#]+\.html(?:\?.*)?$",
        "Airpods": r"^https://(?:www\.)?cellphones\.com\.vn/[^/?#]+\.html(?:\?.*)?$",
    },
    "Viettel Store": {
        PHONE: r"^https://(?:www\.)?viettelstore\.vn/[^?#]*-pid[0-9]+(?:\.html)?/?(?:\?.*)?$",
        TABLET: r"^https://(?:www\.)?viettelstore\.vn/[^?#]*-pid[0-9]+(?:\.html)?/?(?:\?.*)?$",
        WATCH: r"^https://(?:www\.)?viettelstore\.vn/[^?#]*-pid[0-9]+(?:\.html)?/?(?:\?.*)?$",
        "Airpods": r"^https://(?:www\.)?viettelstore\.vn/[^?#]*-pid[0-9]+(?:\.html)?/?(?:\?.*)?$",
    },
    "Phong Vũ": {
        PHONE: r"^https://(?:www\.)?phongvu\.vn/[^?#]*--s[0-9]+(?:\.html)?/?(?:\?.*)?$",
        TABLET: r"^https://(?:www\.)?phongvu\.vn/[^?#]*--s[0-9]+(?:\.html)?/?(?:\?.*)?$",
        LAPTOP: r"^https://(?:www\.)?phongvu\.vn/[^?#]*--s[0-9]+(?:\.html)?/?(?:\?.*)?$",
        WATCH: r"^https://(?:www\.)?phongvu\.vn/[^?#]*--s[0-9]+(?:\.html)?/?(?:\?.*)?$",
        "Airpods": r"^https://(?:www\.)?phongvu\.vn/[^?#]*--s[0-9]+(?:\.html)?/?(?:\?.*)?$",
    },
}

# --- letters that search keys drop the accent of, built from the Unicode decompositions ------------------------------

_MARKS = "".join(chr(c) for c in range(0x0300, 0x0370))


def _base(letter: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", letter) if c not in _MARKS)


_LETTERS = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(_base(c)) == 1 and _base(c) != c]
ACCENTED = "".join(_LETTERS) + "đĐ" + _MARKS
PLAIN = "".join(map(_base, _LETTERS)) + "dD"
