"""Word lists and tables.  Fixed values: results must equal those of earlier schedules."""

from __future__ import annotations

ZONE = "Asia/Almaty"

LIVE_MARKERS = ("ПРЯМАЯ ТРАНСЛЯЦИЯ", "ПРЯМОЙ ЭФИР", "ТІКЕЛЕЙ ЭФИР", "ТIКЕЛЕЙ ЭФИР", "LIVE")

REPLAY_MARKERS = (
    "ПОВТОР", "ЗАПИСЬ", "REPLAY", "RE-RUN", "RERUN", "ARCHIVE", "АРХИВ", "CATCH-UP", "REVIEW", "ОБЗОР", "ШОЛУ", "HIGHLIGHTS", "ПРЕВЬЮ", "PREVIEW", "КЛАССИКА", "CLASSIC",
)

#: Words of a repeat in the guide of strings.
REPEATS_B = ("ПОВТОР", "ЗАПИСЬ", "REPLAY", "АРХИВ")

EDITORIAL_MARKERS = REPLAY_MARKERS + (
    "СТУДИЯ", "СТУДИЙНАЯ ПРОГРАММА", "ТОК-ШОУ", "ЖУРНАЛ", "НОВОСТИ", "SPORT REVIEW", "АРНАЙЫ РЕПОРТАЖ", "СҰХБАТ", "ӘНҰРАН", "ПРОГРАММА ТУР ПО ТУРУ", "КХЛ. ПОДРОБНО", "КХЛ. ТРАНСФЕРЫ", "ДНЕВНИК", "ИТОГИ",
)

SPORT_MARKERS = (
    "ФУТБОЛ", "ХОККЕЙ", "ВОЛЕЙБОЛ", "БАСКЕТБОЛ", "ТЕННИС", "СНУКЕР", "БИЛЬЯРД", "ДЗЮДО", "БОКС", "MMA", "ММА", "UFC", "ФОРМУЛА", "FORMULA", "WRC", "WEC", "МОТОСПОРТ", "АВТОСПОРТ", "БОРЬБ", "АТЛЕТИК", "ГИМНАСТИК", "БИАТЛОН", "КХЛ", "KHL", "ГРАН-ПРИ", "GRAND PRIX", "ЧЕМПИОНАТ", "ТУРНИР", "КУБОК",
)

#: Minutes that a broadcast lasts when its guide has no end.
DURATIONS = {
    "футбол": 150, "хоккей": 150, "баскетбол": 150, "волейбол": 150, "теннис": 180, "бокс": 180, "дзюдо": 150, "биатлон": 120, "лыжный спорт": 120, "лёгкая атлетика": 180, "легкая атлетика": 180, "мотоспорт": 150, "снукер": 180,
}
DEFAULT_DURATION = 120

MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")

#: Letters that are matched as their Russian neighbours.
MATCH_FROM, MATCH_TO = "қғәңөұүіһё", "кганоууихе"
KAZAKH_LETTERS, RUSSIAN_LETTERS = "ҚқҒғҢңӨөҰұҮүІіҺһӘә", "КкГгНнОоУуУуИиХхАа"
MATCH_ALIASES = {"kairat": "кайрат"}

#: Sports told by a word in the text, in this order.
SPORT_HINTS = (
    ("футбол", "Футбол"), ("хоккей", "Хоккей"), ("кхл", "Хоккей"), ("khl", "Хоккей"), ("теннис", "Теннис"), ("снукер", "Снукер"), ("баскетбол", "Баскетбол"), ("волейбол", "Волейбол"), ("ufc", "MMA"), ("mma", "MMA"), ("мма", "MMA"), ("бокс", "Бокс"), ("мотоспорт", "Мотоспорт"), ("формула-1", "Автоспорт"), ("formula 1", "Автоспорт"), ("гран-при", "Автоспорт"), ("grand prix", "Автоспорт"), ("wrc", "Автоспорт"), ("wec", "Автоспорт"), ("дзюдо", "Дзюдо"), ("борьб", "Борьба"), ("бейсбол", "Бейсбол"),
)

#: Evidence methods: what a channel or its guide claims, what others claim, and what only says that a programme is on now.
OFFICIAL_METHODS = ("official_live_badge", "official_live_text", "official_live_asset", "official_live_page_marker", "guide_page_live_text")
THIRD_PARTY_METHODS = ("third_party_live_badge", "third_party_live_text")
ON_AIR_METHODS = ("official_on_air_marker",)
#: Methods that make a provider's broadcast a direct one; of a provider (and only there) nothing else does.
EXPLICIT_METHODS = (
    "official_live_text", "official_live_asset", "provider_live_text", "provider_live_asset", "guide_live_text", "guide_live_asset", "guide_page_live_text", "guide_page_live_asset", "external_schedule_consensus",
)
PROVIDER = "epg"

#: Attributes of an element that may hint at what it is; those that begin with data- do too.
HINT_ATTRIBUTES = ("src", "srcset", "href", "style", "class", "alt")

#: Words of a provider's listing: of repeats and talk, and of events.
EPG_REPLAY = (
    "повтор", "replay", "rerun", "re-run", "архив", "archive", "catch-up", "обзор", "review", "highlights", "лучшее", "итоги", "дневник", "журнал", "классика", "classic", "превью", "preview", "документальный", "новости", "студия", "ток-шоу", "программа", "sport review", "подробно", "трансферы", "best of", "road to", "история", "легенды",
)
EPG_EVENT = (
    "чемпионат", "лига", "кубок", "турнир", "гран-при", "grand prix", "ufc", "khl", "кхл", "финал", "полуфинал", "четвертьфинал", "1/4", "1/2", "теннис", "снукер", "футбол", "хоккей", "баскетбол", "волейбол", "бокс", "mma", "мма", "мотоспорт", "формула-1", "formula 1", "гонк", "дзюдо", "борьб", "биатлон", "атлетик", "гимнастик", "wrc", "wec", "бейсбол",
)

STUDIO_MARKERS = ("студийная программа", "студиялық бағдарлама", "перед матчем", "матч қарсаңында")

#: Words that tell nothing about which event a text is about.
DRAW_WORDS = ("жеребьёвка", "жеребьевка", "draw")

ALIASES = {
    "таиланд": "Thailand", "южная корея": "South Korea", "корея": "Korea", "казахстан": "Kazakhstan", "кыргызстан": "Kyrgyzstan", "узбекистан": "Uzbekistan", "китай": "China", "япония": "Japan", "вьетнам": "Vietnam", "индонезия": "Indonesia", "индия": "India", "иран": "Iran", "турция": "Turkey", "азербайджан": "Azerbaijan", "армения": "Armenia", "грузия": "Georgia", "россия": "Russia", "украина": "Ukraine", "англия": "England", "испания": "Spain", "италия": "Italy", "германия": "Germany", "франция": "France", "португалия": "Portugal", "нидерланды": "Netherlands", "бельгия": "Belgium", "сша": "USA", "канада": "Canada", "бразилия": "Brazil", "аргентина": "Argentina",
    "қайрат": "Kairat", "кайрат": "Kairat", "андерлехт": "Anderlecht",
    "дзюдо": "Judo",
    "лига чемпионов уефа": "UEFA Champions League", "лига европы уефа": "UEFA Europa League", "лига конференций уефа": "UEFA Conference League", "чемпионат азии": "Asian Championship", "кубок азии": "Asian Cup", "чемпионат мира": "World Championship", "кубок мира": "World Cup", "английская премьер-лига": "Premier League", "бундеслига": "Bundesliga", "серия а": "Serie A", "лига 1": "Ligue 1",
    "1/4 финал": "quarterfinal", "1/2 финал": "semifinal", "полуфинал": "semifinal", "финал": "final", "плей-офф": "playoff", "жеребьёвка": "draw", "жеребьевка": "draw",
    "женщины": "Women", "мужчины": "Men",
}

OFFICIAL_DOMAINS = ("fivb.com", "asianvolleyball.net", "uefa.com", "fifa.com", "the-afc.com", "atptour.com", "wtatennis.com", "formula1.com", "ufc.com", "pflmma.com", "nba.com", "nhl.com")
MEDIA_DOMAINS = ("espn.com", "bbc.com", "bbc.co.uk", "reuters.com", "apnews.com", "sports.ru", "championat.com", "sport24.ru", "matchtv.ru", "khaosodenglish.com", "chosun.com", "sbs.co.kr", "xinhuanet.com")
DATABASE_DOMAINS = ("sofascore.com", "flashscore.com", "livesport.com", "soccerway.com", "worldfootball.net")
#: Hours east of Greenwich; Moscow keeps +3.
DOMAIN_HOURS = {
    "baidu.com": 8, "sohu.com": 8, "qq.com": 8, "xinhuanet.com": 8, "thairath.co.th": 7, "thailandedition.com": 7, "bangkokpost.com": 7, "vietnam.vn": 7, "chosun.com": 9, "sbs.co.kr": 9, "sports.ru": 3, "championat.com": 3, "sport24.ru": 3, "matchtv.ru": 3,
}
SUFFIX_HOURS = {"cn": 8, "th": 7, "vn": 7, "kr": 9, "ru": 3, "kz": 5}
#: Zones of the bare clocks of pages, by base domain, then by country.
DOMAIN_ZONES = {
    "ufc.com": "America/New_York", "khl.ru": "Europe/Moscow", "sports.ru": "Europe/Moscow", "championat.com": "Europe/Moscow", "sport24.ru": "Europe/Moscow", "matchtv.ru": "Europe/Moscow", "sports.kz": "Asia/Almaty", "qazsporttv.kz": "Asia/Almaty",
}
SUFFIX_ZONES = {"kz": "Asia/Almaty", "ru": "Europe/Moscow"}
#: Sites of those who hold the events.
OFFICIAL_EVENT_DOMAINS = (
    "ufc.com", "pflmma.com", "formula1.com", "fia.com", "fiawec.com", "wrc.com", "motogp.com", "khl.ru", "nhl.com", "nba.com", "fiba.basketball", "ijf.org", "uefa.com", "fifa.com", "the-afc.com", "premierleague.com", "laliga.com", "bundesliga.com", "legaseriea.it", "ligue1.com", "kff.kz", "kffleague.kz", "atptour.com", "wtatennis.com", "itftennis.com", "wst.tv", "olympics.com", "worldathletics.org", "worldaquatics.com", "fivb.com", "asianvolleyball.net",
)
BETTING_WORDS = ("bet", "odds", "prediction", "bookmaker")
GENERIC_WORDS = ("uefa", "fifa", "league", "лига", "cup", "кубок", "championship", "чемпионат", "tournament", "турнир", "qualifying", "квалификационный", "playoff", "плей", "women", "женщины", "men", "мужчины")
#: Words that tell nothing either where only long words are looked at.
STOP_WORDS = ("match", "матч", "final", "финал", "round", "тур", "season", "сезон", "championship", "чемпионат", "league", "лига", "cup", "кубок", "live", "main", "card", "grand", "prix", "sport", "sports")
TWO_LEVEL_SUFFIXES = ("co.uk", "co.kr", "co.th", "com.au", "com.cn")

STATUS_MARKERS = ("Не начался", "Не началось", "Окончен", "Окончено", "Идёт", "Идет", "Перерыв", "Отложен", "Отложено", "Перенесен", "Перенесён", "Отменен", "Отменён")

SPORT_HEADINGS = {
    "футбол": "Футбол", "хоккей": "Хоккей", "теннис": "Теннис", "баскетбол": "Баскетбол", "волейбол": "Волейбол", "авто": "Автоспорт", "автоспорт": "Автоспорт", "мма": "MMA", "бокс": "MMA", "бокс/мма": "MMA", "биатлон": "Биатлон", "лыжи": "Лыжи", "фигурное катание": "Фигурное катание", "футзал": "Футзал", "регби": "Регби", "гандбол": "Гандбол", "шахматы": "Шахматы", "киберспорт": "Киберспорт", "прочие": "Прочее",
}
NON_MATCH_SPORTS = ("Автоспорт", "Биатлон", "Лыжи", "Фигурное катание", "Прочее")

#: What titles are shown as: phrases, in this order; names of clubs that stand by themselves; and words that stay in capitals.
DISPLAY_PHRASES = (
    ("УЕФА Чемпиондар Лигасы", "Лига чемпионов УЕФА"), ("Чемпиондар Лигасы", "Лига чемпионов"), ("Қазақстан чемпионаты", "Чемпионат Казахстана"), ("Қазақстан Премьер-Лигасы", "Премьер-лига Казахстана"), ("Азия чемпионаты", "Чемпионат Азии"),
    ("Жалпы кезең", "Общий этап"), ("Тікелей эфир", "Прямая трансляция"), ("Grand Slam", "Большой шлем"), ("Формула 1", "Формула-1"),
)
DISPLAY_NAMES = {
    "шахтер": "Шахтёр", "шахтёр": "Шахтёр", "окжетпес": "Окжетпес", "кайрат": "Кайрат", "тобыл": "Тобол", "тобол": "Тобол", "ертис": "Иртыш", "иртыш": "Иртыш", "актобе": "Актобе", "жетису": "Жетысу", "жетысу": "Жетысу", "елимай": "Елимай",
    "кызылжар": "Кызылжар", "улытау": "Улытау", "туран": "Туран", "хан-тенгири": "Хан-Тенгри", "хан-тенгри": "Хан-Тенгри",
}
KEPT_UPPER = ("ATP", "ERC", "F1", "F2", "F3", "FIFA", "HD", "KHL", "LMB", "MMA", "PFL", "UFC", "UEFA", "WRC", "WTA", "КХЛ", "КПЛ", "ЛЧ", "НХЛ", "РПЛ", "УЕФА", "ФИФА")
