"""Keyword lists, thresholds, bands and targets that results depend on."""

# Name parts that mark a date column at load, and when types are inferred.
LOAD_DATE_WORDS = ["date", "time", "날짜", "일자", "시간"]
TYPE_DATE_WORDS = ["date", "time", "year", "month", "day", "일자", "날짜", "연도", "월", "일"]
QUALITY_DATE_WORDS = ["date", "time", "날짜", "일자"]

# Name parts that mark a money column.
MONEY_WORDS = ["price", "amount", "cost", "revenue", "금액", "가격"]

# Currency signs, comma and white space removed from money text.
MONEY_SIGNS = r"[₩,$￦¥€£\s]"

# Text patterns of a date, as Java regular expressions.
DATE_PATTERNS = [
    r"\d{4}[-/]\d{1,2}[-/]\d{1,2}",
    r"\d{1,2}[-/]\d{1,2}[-/]\d{4}",
    r"\d{1,2}[-/]\d{1,2}[-/]\d{2}",
    r"\d{4}\d{2}\d{2}",
    r"\d{4}년\s*\d{1,2}월\s*\d{1,2}일",
]

# Date formats with the shape of text each one is tried on.
DATE_FORMATS = [
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
    ("yyyy-MM-dd'T'HH:mm:ss", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"),
    ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$"),
    ("yyyyMMdd", r"^\d{8}$"),
    ("MM/dd/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("MM-dd-yyyy", r"^\d{2}-\d{2}-\d{4}$"),
    ("yyyy년 M월 d일", r"^\d{4}년 \d{1,2}월 \d{1,2}일$"),
]

# Thresholds of the insight rules.
HIGH_CORRELATION = 0.7
HIGH_MISSING = 5.0
HIGH_SKEW = 1.0
HIGH_OUTLIERS = 5.0

# Targets of the business indicators: growth as a share, values in percent or currency.
TARGET_REVENUE_GROWTH = 0.1
TARGET_CONVERSION = 3.0
TARGET_ORDER_VALUE = 50000.0
TARGET_RETENTION = 30.0
TARGET_MAU_GROWTH = 0.05

# Columns a table should have before the business analyses run.
READINESS_COLUMNS = ["order_id", "user_id", "product_id", "price", "total_price", "category"]

# Right-closed price bands (lower, upper, label).
PRICE_BANDS = [
    (0.0, 10000.0, "under_10k"),
    (10000.0, 30000.0, "10k_30k"),
    (30000.0, 50000.0, "30k_50k"),
    (50000.0, 100000.0, "50k_100k"),
    (100000.0, float("inf"), "over_100k"),
]

# Right-closed hour bands (lower, upper, label); night appears at both ends of the day.
DAYPARTS = [
    (-1, 5, "night"),
    (5, 10, "morning"),
    (10, 14, "lunch"),
    (14, 18, "afternoon"),
    (18, 22, "evening"),
    (22, 24, "night"),
]

SEASONS = {
    "spring": [3, 4, 5],
    "summer": [6, 7, 8],
    "autumn": [9, 10, 11],
    "winter": [12, 1, 2],
}

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Lower score bounds of the quality grades.
GRADES = [(90, "A+"), (80, "A"), (70, "B+"), (60, "B"), (50, "C+"), (40, "C")]

# English stop words, the list in common public use for word counts.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will just don should now"
).split()

# Korean stop words.
KOREAN_STOP_WORDS = ["이", "그", "저", "것", "이것", "저것", "그것", "및", "등", "등등"]

# Seconds-based seasonal period by frequency letter.
DEFAULT_PERIODS = {"S": 60, "T": 60, "H": 24, "D": 7, "W": 52, "M": 12, "Q": 4}

# Scale of the median absolute deviation under a normal distribution.
MAD_SCALE = 1.4826
