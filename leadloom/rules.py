"""Rule tables: every tunable list, weight and threshold of the lead engine.

Plain Python values. The expression builders in ``functions`` and ``operators`` turn them
into Column expressions, so a rule change needs no code change. Everything here is small
and fixed in size; nothing grows with the data.
"""

from __future__ import annotations

from html.entities import html5

# --------------------------------------------------------------------------- fixed values
# Business categories and the search keywords of each.
CATEGORIES: dict[str, list[str]] = {
    "Cosmetics": ["مستحضرات تجميل", "كوزمتيك", "cosmetics", "makeup", "skincare"],
    "Perfumes": ["عطور", "برفان", "perfumes", "fragrance"],
    "Pharmaceuticals": ["شركة أدوية", "مستحضرات دوائية", "pharmaceutical", "pharma"],
    "Home Appliances": ["أدوات منزلية", "أجهزة منزلية", "home appliances", "houseware"],
    "Gift Shops": ["محل هدايا", "هدايا", "gift shop", "gifts"],
    "Clothing": ["ملابس", "أزياء", "clothing", "apparel"],
    "Fashion Brands": ["براند ملابس", "fashion brand", "fashion"],
    "Furniture": ["أثاث", "موبيليا", "furniture"],
    "Electronics": ["إلكترونيات", "أجهزة كهربائية", "electronics"],
    "Food Suppliers": ["موردين أغذية", "مواد غذائية", "food supplier", "food distributor"],
    "Medical Supplies": ["مستلزمات طبية", "أجهزة طبية", "medical supplies", "medical devices"],
    "Factories": ["مصنع", "مصانع", "factory", "manufacturer"],
    "Import & Export": ["استيراد وتصدير", "import export", "trading"],
    "Wholesalers": ["تاجر جملة", "جملة", "wholesale", "wholesaler"],
    "Distributors": ["موزع", "توزيع", "distributor", "distribution"],
    "Plastics": ["بلاستيك", "صناعات بلاستيكية", "plastic", "plastic industries"],
    "Textiles": ["نسيج", "غزل ونسيج", "textile", "textiles"],
    "Chemicals": ["كيماويات", "صناعات كيماوية", "chemical", "chemical industries"],
    "Packaging": ["تعبئة وتغليف", "تغليف", "packaging", "carton"],
    "Garments": ["ملابس جاهزة", "مصنع ملابس", "garments", "clothing factory"],
    "Engineering Industries": ["صناعات هندسية", "منتجات معدنية", "engineering industries", "metal products"],
    "Freight Forwarder": ["شحن دولي", "تخليص جمركي", "freight forwarder", "logistics", "customs clearance"],
}

# Company types and the phrases that point to them. The order decides ties.
COMPANY_TYPE_SIGNALS: dict[str, list[str]] = {
    "Freight Forwarder": [
        "freight forwarder", "freight forwarding", "forwarder", "forwarding agent",
        "customs clearance", "customs broker", "customs brokerage", "nvocc",
        "bill of lading", "تخليص جمركي", "تخليص", "شحن دولي", "وكيل شحن", "ملاحة",
    ],
    "Manufacturer": [
        "manufacturer", "manufacturing", "factory", "we produce", "our factory",
        "production line", "مصنع", "تصنيع", "إنتاج", "خط إنتاج",
    ],
    "Importer": ["importer", "we import", "import of", "استيراد", "مستورد"],
    "Exporter": ["exporter", "we export", "export to", "export of", "exporting", "تصدير", "مصدر", "مصدّر"],
    "Distributor": [
        "distributor", "distribution", "wholesale", "wholesaler",
        "موزع", "توزيع", "جملة", "تاجر جملة",
    ],
    "Ecommerce": [
        "add to cart", "shop now", "online store", "checkout", "shopify",
        "woocommerce", "salla", "zid", "متجر إلكتروني", "اطلب الآن", "أضف إلى السلة", "سلة", "زد",
    ],
}
CUSTOMER_TYPES = ["Manufacturer", "Exporter", "Importer", "Distributor", "Ecommerce"]
STRONG_FORWARDER = [
    "freight forwarder", "freight forwarding", "forwarding agent", "customs clearance",
    "customs broker", "customs brokerage", "nvocc", "bill of lading", "تخليص جمركي",
    "شحن دولي", "وكيل شحن",
]

# Phrases that show shipping intent, with their points.
INTENT_SIGNALS: dict[str, int] = {
    "we export": 30, "we import": 30, "international shipping": 30, "worldwide shipping": 30,
    "شحن دولي": 30, "export": 25, "import": 25, "تصدير": 25, "استيراد": 25,
    "gcc": 20, "middle east": 15, "ship to": 15, "delivery": 10, "shipping": 10,
    "wholesale": 15, "distributor": 15, "جملة": 15, "الخليج": 20, "توصيل": 10, "شحن": 10,
}
TYPE_BASE_INTENT = {
    "Exporter": 35, "Importer": 35, "Manufacturer": 25,
    "Distributor": 20, "Freight Forwarder": 25, "Ecommerce": 15, "Unknown": 0,
}
STORE_MARKERS = ["shopify.shop", "/cart", "woocommerce", "add to cart", "shop now", "salla", "zid"]
STORE_INTENT_BONUS = 10
MARKET_INTENT_BONUS = 5
MAX_INTENT = 100

# Shop platforms; the first whose marker occurs wins.
STORE_PLATFORMS: dict[str, list[str]] = {
    "Shopify": ["myshopify.com", "cdn.shopify", "shopify.shop", "powered by shopify"],
    "WooCommerce": ["woocommerce", "wp-content/plugins/woocommerce", "wc-ajax"],
    "Salla": ["salla.sa", "salla.shop", "cdn.salla", "متجر سلة"],
    "Zid": ["zid.store", "zid.sa", "متجر زد"],
    "Magento": ["magento", "/static/version", "mage/cookies"],
    "WordPress": ["wp-content", "wp-json"],
}

# Markets a text can talk about.
MARKET_SIGNALS: dict[str, list[str]] = {
    "GCC": [
        "gcc", "gulf", "الخليج", "saudi", "ksa", "uae", "emirates", "dubai", "jeddah",
        "riyadh", "qatar", "kuwait", "bahrain", "oman", "السعودية", "الإمارات", "قطر", "الكويت",
    ],
    "Europe": [
        "europe", "european", " eu ", "germany", "france", "italy", "spain",
        "united kingdom", " uk ", "netherlands", "أوروبا",
    ],
    "Africa": ["africa", "african", "sudan", "libya", "nigeria", "kenya", "morocco", "إفريقيا", "أفريقيا", "السودان"],
    "Americas": ["usa", "u.s.", "united states", " america", "canada", "brazil", "أمريكا"],
    "Asia": ["china", "india", " asia", "far east", "singapore", "الصين", "الهند", "آسيا"],
    "Local (Egypt)": ["egypt", "cairo", "alexandria", "مصر", "القاهرة", "الإسكندرية"],
}
LOCAL_MARKET_PREFIX = "Local"

# Decision-maker roles, strongest first, with the titles that name them.
ROLE_TITLES: dict[str, list[str]] = {
    "Export Manager": [
        "export manager", "export director", "head of export", "export sales manager",
        "مدير التصدير", "مدير الصادرات", "مدير قطاع التصدير", "مسؤول التصدير",
    ],
    "Logistics Manager": [
        "logistics manager", "supply chain manager", "logistics director", "head of logistics",
        "shipping manager", "مدير اللوجستيات", "مدير الخدمات اللوجستية", "مدير سلسلة الإمداد", "مدير الشحن",
    ],
    "Owner / CEO": [
        "chief executive", "ceo", "managing director", "general manager", "owner",
        "founder", "co-founder", "chairman", "الرئيس التنفيذي", "المدير العام",
        "المالك", "صاحب الشركة", "مؤسس", "رئيس مجلس الإدارة",
    ],
}
ROLE_MAILBOXES = [
    "info", "sales", "contact", "support", "admin", "office", "mail",
    "hello", "customercare", "care", "service", "enquiry", "inquiries",
]

# E-mail junk: one list for cells of a listing, one for addresses found on pages.
CELL_EMAIL_JUNK = ["noreply", "no-reply", "example.com", "example.org", "sentry", "wixpress"]
PAGE_EMAIL_JUNK = [
    "example.com", "example.org", "sentry", "wixpress", "wix.com", "godaddy",
    "domain.com", "yourdomain", "email.com", "test@", "noreply", "no-reply",
]
PAGE_EMAIL_BAD_ENDINGS = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".css", ".js"]

# Links.
FACEBOOK_WIDGETS = ["sharer", "share.php", "/plugins/", "/dialog/", "facebook.com/tr", "/login", "/events/"]
FACEBOOK_NO_HANDLE = ["pages", "profile.php", "people"]
SOCIAL_HOSTS = ["facebook", "twitter", "linkedin", "youtube", "instagram", "google", "whatsapp", "pinterest", "t.me"]
CONTACT_PAGE_HINTS = ["contact", "تواصل", "اتصل", "اتصل-بنا", "call", "reach"]
OTHER_PAGE_HINTS = [
    "about", "services", "service", "products", "product", "company",
    "profile", "عن", "نبذة", "من-نحن", "خدمات", "المنتجات",
]
SITE_PAGE_BUDGET = 4
PAGE_TTL_SECONDS = 86400

# Which categories a directory is asked for.
TEXTILE_HINTS = ["textile", "garment", "clothing", "fashion", "apparel", "spinning", "weaving", "fabric", "yarn", "cotton"]
APPAREL_HINTS = ["apparel", "garment", "clothing", "fashion", "textile", "ready", "wear", "cotton", "knit"]
FREIGHT_HINTS = ["freight", "forward", "logistic", "customs", "truck", "shipping", "cargo", "clearance"]
FREIGHT_CATEGORY_NEEDLES: dict[str, str] = {
    "freight forwarder": "Freight Forwarder",
    "forwarder": "Freight Forwarder",
    "logistics": "Freight Forwarder",
    "customs": "Customs Clearance Offices",
    "customs clearance": "Customs Clearance Offices",
    "trucking": "Trucking Companies",
    "transport": "Trucking Companies",
}
FREIGHT_DEFAULT_CATEGORY = "Freight Forwarder"

# Words of a role in a search text.
ROLE_WORDS = {
    "Manufacturer": "manufacturers", "Factory": "factories", "Importer": "importers",
    "Exporter": "exporters", "Distributor": "distributors", "Wholesaler": "wholesalers",
    "Supplier": "suppliers",
}
PLACE_LABELS = ["phone:", "website:", "address:", "الهاتف:", "العنوان:"]

# Quality filters.
FILTERS = {
    "activity": {"enabled": True, "drop_if_year_at_or_before": 2023, "drop_if_activity_unknown": False},
    "followers": {"enabled": True, "min": 1000},
    "require_contact": True,
    "require_phone": False,
    "require_website": False,
}

# Segments.
SEGMENTS = {
    "service_keywords": [
        "marketing", "advertising", "digital agency", "تسويق", "دعاية", "اعلان", "accounting",
        "محاسبة", "software", "برمجة", "it solutions", "information technology", "تكنولوجيا المعلومات",
        "consulting", "consultancy", "استشارات", "clinic", "عيادة", "medical center", "hospital",
        "law firm", "محاماة", "محامي", "human resources", "recruitment", "موارد بشرية", "توظيف",
        "training", "تدريب", "travel agency", "سياحة", "real estate", "عقارات",
    ],
    "p1_categories": [
        "Cosmetics", "Perfumes", "Pharmaceuticals", "Home Appliances", "Clothing", "Fashion Brands",
        "Furniture", "Electronics", "Food Suppliers", "Medical Supplies", "Factories", "Plastics",
        "Textiles", "Chemicals", "Packaging", "Garments", "Engineering Industries", "Wholesalers",
        "Distributors",
    ],
    "p2_categories": ["Gift Shops"],
    "p3_categories": ["Import & Export"],
    "p3_sources": ["textile_council", "aece", "goeic"],
}
PRODUCT_TYPES = ["Manufacturer", "Importer", "Distributor"]

# Scores.
SCORING = {
    "max_score": 100,
    "base_bands": {
        "product_maker": 62, "trader": 52, "ecommerce": 60, "general_trading": 38,
        "service": 20, "competitor": 10, "default": 32,
    },
    "bonuses": {
        "has_website": 10, "has_online_store": 12, "ships": 8, "has_phone": 6,
        "has_email": 5, "has_contact_person": 6, "has_linkedin": 4,
    },
    "tiers": {"Hot": 65, "Medium": 40, "Weak": 0},
}
ADDITIVE_TIERS = {"Hot": 61, "Medium": 31, "Weak": 0}
MAKER_TYPES = ["Manufacturer", "Exporter"]
TRADER_TYPES = ["Importer", "Distributor"]
FLAT_BANDS = ["service", "competitor"]
SHIPS_INTENT = 40
TIER_RANK = {"Weak": 0, "Medium": 1, "Hot": 2}

REASON_LABELS = {
    "has_website": "موقع ✓",
    "has_phone": "رقم ✓",
    "has_email": "إيميل ✓",
    "has_linkedin": "LinkedIn ✓",
    "has_contact_person": "مسؤول تواصل ✓",
    "has_online_store": "متجر إلكتروني ✓",
    "ships": "بيشحن ✓",
    "multiple_branches": "فروع متعددة ✓",
    "in_freight_directory": "شركة شحن ✓",
    "recent_activity": "نشاط حديث ✓",
    "followers": "متابعين كفاية ✓",
    "shipping_intent": "نية شحن ✓",
    "band:product_maker": "مصنع/منتج ✓",
    "band:trader": "مستورد/موزّع ✓",
    "band:ecommerce": "متجر إلكتروني ✓",
    "band:general_trading": "تجارة عامة",
    "band:service": "شركة خدمات",
    "band:competitor": "منافس (شحن)",
    "band:default": "غير مصنّف",
}
REASON_SEPARATOR = "، "

# Sales stages and their labels; quarantined records stand outside the funnel.
STATUS_LABELS = {
    "new": "جديد",
    "contacted": "تم التواصل",
    "interested": "مهتم",
    "quotation_sent": "اتبعت عرض سعر",
    "negotiation": "تفاوض",
    "won": "تعاقد ✅",
    "lost": "خسارة",
}
ENGAGED = ["contacted", "interested", "quotation_sent", "negotiation", "won"]
CLOSED = ["won", "lost"]
QUARANTINED = "quarantined"
CRM_FIELDS = ["status", "notes", "assigned_to", "last_contact_date", "next_followup_date"]

# Error texts that mean a source turned us away.
BLOCK_SIGNALS = ["403", "429", "forbidden", "captcha", "cloudflare", "blocked", "access denied", "too many requests"]

# Source catalogue: key -> (label, tier, enabled, required flag).
SOURCES: dict[str, tuple[str, str, bool, str | None]] = {
    "dummy": ("Demo data (offline)", "green", True, None),
    "egydir": ("EgyDir (egydir.com)", "green", False, None),
    "kompass_eg": ("Kompass Egypt (eg.kompass.com)", "green", False, None),
    "freightclub": ("Freight Club Directory (freightclub.net)", "green", True, None),
    "wsdconnect": ("World Shipping Directory (wsdconnect.com)", "green", True, None),
    "forwarding_companies": ("Forwarding Companies (forwardingcompanies.com)", "green", True, None),
    "textile_council": ("Textile Export Council of Egypt (textile-egypt.org)", "green", True, None),
    "aece": ("Apparel Export Council of Egypt (aecegy.com)", "green", True, None),
    "google_maps": ("Google Maps — العملاء النهائيين (مصانع/موردين/مصدّرين)", "yellow", True, None),
    "yellowpages_eg": ("Yellow Pages Egypt (yellowpages.com.eg)", "yellow", True, None),
    "facebook": ("Facebook (DEFERRED — ToS risk)", "deferred", False, "FEATURE_FACEBOOK"),
    "instagram": ("Instagram (DEFERRED — ToS risk)", "deferred", False, "FEATURE_INSTAGRAM"),
    "linkedin": ("LinkedIn (DEFERRED — ToS risk)", "deferred", False, "FEATURE_LINKEDIN"),
    "truecaller": ("Truecaller enrichment (DEFERRED — ToS risk)", "deferred", False, "FEATURE_TRUECALLER"),
}

# The unattended plan.
PLAN = {
    "country": "Egypt",
    "daily_limit": 12,
    "max_results_per_source": 30,
    "enrich": True,
    "directory_sources": ["yellowpages_eg", "google_maps"],  # asked once per request
    "council_sources": ["textile_council", "aece"],          # swept once per run, for no request
    "roles": ["Manufacturer", "Factory", "Importer", "Distributor", "Exporter"],
    "places": ["Cairo", "Giza", "Alexandria", "Qalyubia", "Sharqia", "Gharbia", "Dakahlia",
               "10th of Ramadan", "6th of October", "Port Said"],
    "categories": ["Cosmetics", "Perfumes", "Pharmaceuticals", "Home Appliances", "Clothing", "Furniture",
                   "Electronics", "Food Suppliers", "Medical Supplies", "Plastics", "Textiles", "Packaging",
                   "Garments", "Chemicals", "Engineering Industries"],
    "roleless_categories": ["Gift Shops"],
}
INTERACTIVE_LIMIT = 120

# Export table: field -> header, in column order.
EXPORT_COLUMNS: dict[str, str] = {
    "company_name": "Company", "phone_e164": "Phone", "whatsapp": "WhatsApp", "extra_phones": "Extra Phones",
    "email": "Email", "website": "Website", "category": "Category", "company_type": "Type",
    "shipping_intent": "Intent", "target_markets": "Markets", "city": "City", "country": "Country",
    "address": "Address", "score": "Score", "tier": "Tier", "status": "Status", "assigned_to": "Assigned To",
    "next_followup_date": "Next Follow-up", "source": "Source", "sources_seen": "All Sources",
    "source_url": "Source URL", "segment": "Segment", "product_type": "Product Type", "store_platform": "Store",
    "facebook": "Facebook", "linkedin": "LinkedIn", "contact_name": "Contact Name",
    "contact_role": "Contact Role", "contact_email": "Contact Email",
}

# Contact feed: header -> field, first the lead's own columns, then the later additions.
FEED_HEADER = [
    "Company", "Phone", "WhatsApp", "Extra Phones", "Email", "Website", "Category",
    "Type", "Intent", "Markets", "City", "Country", "Address", "Score", "Tier", "Status",
]
FEED_ADDED = [
    "Facebook", "LinkedIn", "Product Type", "Store Platform",
    "Contact Name", "Contact Role", "Contact Email", "Segment", "Source", "Added Date",
]

# Numbering plans: region -> country code, has trunk zero, national significant number.
NUMBERING: dict[str, tuple[str, bool, str]] = {
    "EG": ("20", True, r"1[0-25]\d{8}|13[23]\d{6}|(?:15|57)\d{6,7}|(?:2[2-4]|3|4[05-8]|5[05]|6[24-689]|8[2468]|9[235-7])\d{7}|[89]00\d{7}"),
    "SA": ("966", True, r"1[1-7]\d{7}|5[0-9]\d{7}|800\d{7}"),
    "AE": ("971", True, r"[2-4679][2-8]\d{6}|5[024-68]\d{7}"),
    "KW": ("965", False, r"2[2-5]\d{6}|[569]\d{7}"),
    "QA": ("974", False, r"4[04]\d{6}|[35-7]\d{7}"),
    "JO": ("962", True, r"[2356]\d{7}|7[7-9]\d{7}"),
    "LY": ("218", True, r"[2-8]\d{7,8}|9[1-6]\d{7}"),
    "SD": ("249", True, r"1(?:5\d|8[35-7])\d{6}|(?:1[0-2]|9[0-3569])\d{7}"),
}
# Other calling codes: digits of the national number, from and to.
WORLD_LENGTHS: dict[str, tuple[int, int]] = {
    "1": (10, 10), "7": (10, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (6, 11),
    "40": (9, 9), "41": (9, 9), "43": (7, 13), "44": (9, 10), "45": (8, 8), "46": (7, 10), "47": (8, 8), "48": (9, 9), "49": (7, 11), "51": (8, 9),
    "52": (10, 10), "53": (6, 8), "54": (10, 11), "55": (10, 11), "56": (9, 9), "57": (8, 10), "58": (10, 10), "60": (8, 10), "61": (9, 9), "62": (8, 12),
    "63": (8, 10), "64": (8, 10), "65": (8, 8), "66": (8, 9), "81": (9, 10), "82": (8, 10), "84": (9, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10),
    "92": (9, 10), "93": (9, 9), "94": (9, 9), "95": (7, 10), "98": (10, 10), "211": (9, 9), "212": (9, 9), "213": (8, 9), "216": (8, 8), "220": (7, 7),
    "221": (9, 9), "222": (8, 8), "223": (8, 8), "224": (8, 9), "225": (10, 10), "226": (8, 8), "227": (8, 8), "228": (8, 8), "229": (8, 8), "230": (7, 8),
    "231": (7, 9), "232": (8, 8), "233": (9, 9), "234": (8, 10), "235": (8, 8), "236": (8, 8), "237": (9, 9), "238": (7, 7), "239": (7, 7), "240": (9, 9),
    "241": (7, 8), "242": (9, 9), "243": (9, 9), "244": (9, 9), "245": (7, 9), "248": (7, 7), "250": (9, 9), "251": (9, 9), "252": (7, 9), "253": (8, 8),
    "254": (9, 9), "255": (9, 9), "256": (9, 9), "257": (8, 8), "258": (8, 9), "260": (9, 9), "261": (9, 10), "262": (9, 9), "263": (5, 10), "264": (8, 9),
    "265": (7, 9), "266": (8, 8), "267": (7, 8), "268": (8, 8), "269": (7, 7), "291": (7, 7), "297": (7, 7), "298": (6, 6), "299": (6, 6), "350": (8, 8),
    "351": (9, 9), "352": (6, 9), "353": (7, 9), "354": (7, 7), "355": (8, 9), "356": (8, 8), "357": (8, 8), "358": (6, 11), "359": (7, 9), "370": (8, 8),
    "371": (8, 8), "372": (7, 8), "373": (8, 8), "374": (8, 8), "375": (9, 9), "376": (6, 6), "377": (8, 9), "378": (6, 10), "380": (9, 9), "381": (8, 9),
    "382": (8, 8), "383": (8, 8), "385": (8, 9), "386": (8, 8), "387": (8, 8), "389": (8, 8), "420": (9, 9), "421": (9, 9), "423": (7, 7), "501": (7, 7),
    "502": (8, 8), "503": (8, 8), "504": (8, 8), "505": (8, 8), "506": (8, 8), "507": (7, 8), "509": (8, 8), "590": (9, 9), "591": (8, 8), "592": (7, 7),
    "593": (8, 9), "594": (9, 9), "595": (9, 9), "596": (9, 9), "597": (6, 7), "598": (8, 8), "599": (7, 8), "670": (7, 8), "673": (7, 7), "675": (7, 8),
    "676": (5, 7), "677": (5, 7), "679": (7, 7), "685": (5, 7), "687": (6, 6), "689": (6, 8), "852": (8, 8), "853": (8, 8), "855": (8, 9), "856": (8, 10),
    "880": (8, 10), "886": (8, 9), "960": (7, 7), "961": (7, 8), "963": (8, 9), "964": (8, 10), "967": (7, 9), "968": (8, 8), "970": (8, 9), "972": (8, 9),
    "973": (8, 8), "975": (7, 8), "976": (8, 8), "977": (8, 10), "992": (9, 9), "993": (8, 8), "994": (9, 9), "995": (9, 9), "996": (9, 9), "998": (9, 9),
    "246": (7, 7), "247": (5, 6), "290": (4, 5), "500": (5, 5), "508": (6, 9), "672": (6, 6), "674": (7, 7), "678": (5, 7), "680": (7, 7), "681": (6, 9),
    "682": (5, 5), "683": (4, 7), "686": (5, 8), "688": (5, 7), "690": (4, 7), "691": (7, 7), "692": (7, 7), "850": (8, 10),
    "22901": (8, 8),  # the ten digits of today, beside the eight of before
}
# Codes of no country: freephone, shared cost, satellite, personal and premium numbers.
WORLD_LENGTHS |= {"800": (8, 8), "808": (8, 8), "870": (9, 12), "878": (12, 12), "881": (8, 10), "882": (7, 12), "883": (7, 15), "979": (9, 9)}
# Leading digits of national numbers, where not just any but zero will do.
WORLD_LEADING: dict[str, str] = {
    "1": r"[2-9][0-8]\d[2-9]", "7": "[3-9]", "27": "[1-8]", "30": "[25-9]", "31": "[1-9]", "32": "[1-9]", "33": "[1-9]", "34": "[5-9]", "36": "[1-9]", "40": "[237-9]", "41": "[2-9]",
    "44": "[1-357-9]", "45": "[2-9]", "47": "[2-9]", "48": "[1-9]", "51": "[14-9]", "52": "[2-9]", "55": r"[1-9][1-9]|[1-9]0", "56": "[2-9]", "60": "[1-9]", "61": "[1-578]", "65": "[3689]",
    "66": "[1-9]", "81": "[1-9]", "84": "[1-9]", "86": "1[03-9]|[2-9]", "90": "[2-58]", "91": "[1-9]", "98": "[1-9]", "212": "[5-8]", "213": "[1-9]", "216": "[2-57-9]", "233": "[235]",
    "234": "[1-9]", "254": "[1-9]", "351": "[2-9]", "380": "[3-9]", "420": "[2-9]", "852": "[2-9]", "961": "[1-9]", "963": "[1-59]", "964": "[1-7]", "967": "[1-7]", "968": "[1-9]",
    "970": "[2-59]|1[78]", "972": "[1-57-9]", "973": "[136-9]", "881": "[0-36-9]", "800": r"\d", "808": r"\d", "870": "[35-7]", "878": "10", "882": r"[13]", "883": r"\d", "979": r"\d",
}
# Codes whose national numbers keep a leading zero.
KEEP_ZERO = ("39", "378", "225", "229", "22901", "242", "800", "808", "870", "878", "881", "882", "883", "979")
DEFAULT_REGION = "EG"
DEFAULT_COUNTRY = "Egypt"

# Named character references: the standard library's table of HTML names, with ``;`` where one has to follow.
NAMED_ENTITIES = html5
# What the numbers 128 to 159 stand for in pages: the characters of that code page, itself where it has none.
NUMBERED_ENTITIES = [bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)]
# --------------------------------------------------------------------- end of fixed values
