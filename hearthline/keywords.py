"""Default keyword packs and scales. Every function that uses one takes it as a parameter."""

URGENCY = ("срочно", "urgent", "торг", "скидк", "price reduced", "цена сниж", "без комиссии")
OWNER = ("собственник", "owner", "без комиссии", "без посредников", "без агент")
AGENT = ("агент", "риэлтор", "агентство", "broker", "agency")
DISCOUNT = ("скидк", "торг", "цена сниж", "price reduced", "дешев", "ниже рынка")
IDENTITY_OWNER = ("собственник", "от собственника", "без комиссии", "прямой договор", "в собственности")
IDENTITY_AGENT = ("комиссия", "агентство", "подберем", "есть другие варианты", "риэлтор", "брокер", "агент")
IDENTITY_URGENCY = ("срочно", "горяч", "скидка", "снижение", "торг", "быстрый", "urgent")
NEGOTIATION = ("торг", "обсудим", "гибкие условия", "возможен торг")
LEGAL_FORMS = ("ооо", "ип", "ао", "пао", "зао", "оао", "гк", "тоо")
# Forms that a name loses before names are compared; one is spelt with Latin letters.
NAME_FORMS = ("ооо", "ип", "ао", "пao", "пао", "зао", "оао", "гк", "тоо")
PROPERTY_RULES = (("warehouse", ("склад",)), ("office", ("офис",)), ("industrial", ("производ", "индустри")), ("retail", ("торгов", "магаз")), ("land", ("земел", "участ")), ("free_purpose", ("свобод", "псн")))
RENT, SALE = ("аренд",), ("продаж",)
AREA_BANDS = ((0, 10, "до 10"), (10, 30, "10-30"), (30, 80, "30-80"), (80, 150, "80-150"), (150, 300, "150-300"), (300, 500, "300-500"), (500, 800, "500-800"), (800, 1000, "800-1000"), (1000, 1500, "1000-1500"), (1500, 2000, "1500-2000"), (2000, 10_000_000, "2000+"))
EDGE_CONFIDENCE = {"contact_to_listing": 0.9, "listing_to_object": 0.8, "object_to_address": 0.7, "contact_to_organization": 0.6, "organization_to_object": 0.6, "contact_to_address": 0.6, "listing_to_source": 0.7}
# Listings: signs of renting and selling in an address and in a text, and words of those who invest, rent and sell.
RENT_URLS, SALE_URLS = ("snyat", "rent", "arenda", "lease", "/arenda", "/rent"), ("kupit", "sale", "sell", "prodazha", "/sale")
LISTING_RENT = ("аренд", "сдам", "сдается", "сдаем", "сниму", "арендую", "rent", "lease", "sublease")
LISTING_SALE = ("продаж", "продает", "продам", "куплю", "купить", "sale", "sell")
INVESTOR, TENANT, SELLER = ("инвест", "доходност", "окупаем", "cap rate"), ("сниму", "ищу аренду", "арендую", "take lease"), ("продам", "продажа", "собственник", "owner")
# Messages: what a relevant one must hold a word of, pack by pack, what it must not hold, and the words of the region.
MESSAGE_COMMERCIAL = ("коммерческ", "недвижим", "нежил", "офис", "склад", "торгов", "аренда", "продажа", "business center", "warehouse", "retail", "office")
MESSAGE_ESTATE = ("недвижим", "офис", "помещен", "торгов", "нежил", "бизнес-центр", "бизнес центр", "земельн", "площад", "кв.м", "кв м", "м2", "м²")
MESSAGE_TRANSACTION = ("аренд", "продаж", "продам", "сдам", "сниму", "куплю", "инвест", "ипотек", "lease", "rent", "sale")
MESSAGE_EXCLUDE = ("квартир", "жилой", "жилье", "новострой", "ипотек", "крипт", "майнинг")
MESSAGE_REGION = ("удмурт", "удмуртия", "ижевск", "сарапул", "глазов", "воткинск", "можга", "камбарка", "балезино", "udmurt", "udmurtia", "izhevsk")
# Words that sources are searched by.
SEARCH_PACK = (
    "аренда офиса", "аренда склада", "продажа коммерческой недвижимости", "помещение свободного назначения", "торговое помещение", "бизнес-центр", "складской комплекс",
    "собственник", "без комиссии", "продажа здания", "индустриальная недвижимость", "производственное помещение",
)
SEARCH_HOSTS = ("duckduckgo.com", "yandex.ru", "yandex.kz", "google.com", "bing.com")
# Crawled pages: words of the trade, hints in the address of a listing, and the words that tell kinds of sources apart, in the order of the rules.
COMMERCIAL = ("коммерческ", "недвижим", "офис", "склад", "торгов", "помещен", "аренд", "продаж", "бизнес-центр", "бц", "warehouse", "office", "retail", "industrial")
LISTING_HINTS = ("/commercial", "/kommerchesk", "/office", "/warehouse", "/sklad", "/arenda", "/rent", "/sale", "/prodazha", "/catalog", "/listing")
SOURCE_KINDS = (
    ("auction", ("банкрот", "торги", "auction")), ("government", (".gov.ru", "гос", "реестр")), ("business_center", ("бизнес-центр", "бизнес центр", "бц")), ("mall", ("торговый центр", "тц", "mall")),
    ("developer", ("застройщик", "developer", "девелопер")), ("agency", ("агентство", "риэлтор", "broker", "agency")), ("classifieds", COMMERCIAL),
)
SOURCE_HOSTS = (("avito", "avito"), ("cian", "cian"), ("domclick", "domclick"), ("yandex", "yandex"), ("t.me", "telegram"))
LISTING_PATHS = {"avito": ("avito.ru", r"_\d{5,}"), "cian": ("cian.ru", r"/(?:rent|sale)/commercial/\d+/?$"), "domclick": ("domclick.ru", r"/card/|commerce"), "yandex": ("realty.yandex.ru", r"/(?:offer|commercial)/\d+/?$")}
AUCTION_LINKS = ("bankrot", "банкрот", "торги", "torgi", "auction")
# Contacts: who speaks, what points at the seller, what points at a service desk or an advertiser, and how sure each class is.
CONTACT_OWNER = ("собственник", "владел", "прямой", "без комиссии", "продавец", "арендодатель", "owner")
CONTACT_AGENT = ("агент", "риэлтор", "брокер", "менеджер", "agent", "realtor", "broker")
CONTACT_HINT = ("контакт", "телефон", "phone", "whatsapp", "telegram")
CONTACT_SUPPORT = ("поддерж", "служба поддержки", "техподдерж", "контактный центр", "горячая линия", "обратная связь", "реклам", "размещен", "support", "help", "feedback", "helpdesk", "customer support", "call center")
CONTACT_ADS = ("реклам", "advert", "ads")
CONTACT_EMAIL_PREFIXES = ("help", "support", "info", "no-reply", "noreply", "feedback", "admin", "press", "hr", "jobs", "career", "marketing", "ads", "advert", "sales")
CONTACT_CONFIDENCE = {"owner_candidate": 0.9, "agent_candidate": 0.75, "organization_contact": 0.6, "unknown_contact": 0.35, "platform_contact": 0.1, "support_contact": 0.1}
