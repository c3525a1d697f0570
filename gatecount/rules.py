"""Thresholds, word lists, patterns and model constants.

Every value in this file has to be what it is for results to be comparable with
published figures; none of it is tuned here. Operators take these as parameter
defaults, so another domain passes its own.
"""

# --- fixed values: titles ---------------------------------------------------
NOISE_PATTERNS = (
    r"\b(dabing|dabovan[eya]|titulky|tit\.?)\b",
    r"\b(2d|3d|4dx|imax|screenx|4k|hfr|vip|premium)\b",
    r"\b(cz|sk|en|ua)\s*(dab|tit)\b",
)
FORMAT_LABELS = {"3d": "3D", "4dx": "4DX", "imax": "IMAX", "70mm": "70mm", "screenx": "ScreenX"}
DEFAULT_FORMAT = "2D"
VERSION_WORDS = ("dabing", "titulky")
VERSION_LABELS = {"DAB": "dabing", "TIT": "titulky"}
DUBBED_ISO = "cs"
REVIEW_PATTERN = r"(?iu)\b(recenze|kritika|hodnocen[íi]|dojmy)\b"
ALTERNATIVE_PATTERN = r"(?iu)^Alternativn[íi] program$"
HOME_COUNTRY_PATTERN = r"(?i)^(CZ|CZE)$"

# --- fixed values: seats ----------------------------------------------------
FREE_STATES = ("FREE",)
UNSELLABLE_STATES = ("BROKEN", "BLOCKED", "DISABLED")
CAPACITY_RESIDUAL = 0.05
DEFAULT_PRICE = 205.0

# --- fixed values: time -----------------------------------------------------
LOCAL_ZONE = "Europe/Prague"
WALL_CLOCK_PATTERN = r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2})(?::(\d{2}))?"
BUSINESS_DAY_CUTOFF_HOURS = 5
# (time to start at most, look again after), in minutes; then the far interval.
LOOK_TIERS = ((120, 10), (720, 30), (2880, 120))
FAR_LOOK_MINUTES = 720
LAST_LOOK_LEAD_MINUTES = 5
RECHECK_MINUTES = 5
FINAL_LEAD_MINUTES = 15
SETTLE_GRACE_MINUTES = 30
FOLD_AFTER_DAYS = 10
RAMP_RETENTION_DAYS = 21
COVERAGE_DAYS = 7
DISCOVERY_DAYS = 45
CLOSING_WINDOW_MINUTES = 60
SELLOUT_APPROACH = 0.8
CURRENT_RUN_DAYS = 200
HANDOVER_DAYS = 4
CONTEXT_STALE_HOURS = 6
CONTEXT_MIN_ADMISSIONS = 50
CONTEXT_LIMIT = 12
MIN_VOTES = 20
HEADLINES_KEPT = 8
FORECASTS_KEPT = 40
RANKING_LIMIT = 100
MIN_PAST_SCREENINGS = 8
FULLEST_MIN_CAPACITY = 40
ALERT_STEP = 100
ALERT_QUIET_MINUTES = 10

# --- fixed values: report layout ---------------------------------------------
WEEK_FILE_PATTERN = r"(?i)top20-(\d{4})-(\d{1,2})cz\.xlsx?$"
ANNUAL_FILE_PATTERN = r"(?i)top50(\d{4})\.xlsx?$"
WEEKEND_CAPTION_PATTERN = r"(?iu)V[íi]kend od:\s*(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})"
LIFETIME_CAPTION_PATTERN = r"(?i)od prem"

# --- fixed values: run model --------------------------------------------------
HOLD_BY_WEEK = {
    "cz": (0.51, 0.583, 0.623, 0.656, 0.751),
    "foreign": (0.516, 0.618, 0.642, 0.686, 0.701),
}
TAIL_HOLD = 0.5
HOLD_CONFIDENCE = 0.4
RECENCY_WEIGHT = 0.6
WEEKDAY_UPLIFT = {"cz": 1.634, "foreign": 1.513}
INTENSITY_PIVOT, INTENSITY_POWER, INTENSITY_LOW, INTENSITY_HIGH = 160.0, 0.5, 0.6, 1.3
SCREEN_DECLINE = (0.602, 0.711, 0.796, 0.809, 0.81, 0.826)
SCREEN_ELASTICITY = 0.75
SCREEN_DEVIATION_LOW, SCREEN_DEVIATION_HIGH = 0.5, 1.6
MAX_FURTHER_WEEKS = 10
MIN_WEEKEND_ADMISSIONS = 300
MAX_RATE = 0.95
MIN_OBSERVED_HOLD = 0.05
PREVIEW_SHARE = 0.35
SPREAD = ((0.57, 2.09), (0.66, 1.35), (0.83, 1.3), (0.89, 1.29), (0.94, 1.27))

# --- fixed values: markup and feed fields -------------------------------------
PAYLOAD_SCRIPT = r'(?s)<script type="application/json"[^>]*id="__NUXT_DATA__"[^>]*>(.*?)</script>'
DAY_LABEL = r'big-date-a">(\d{2}\.\d{2}\.\d{4})<'
DAY_BLOCK = r"""(?i)<div class=['"]tab-item[^>]*>"""
VENUE_HEADING = r'cinema-name">([^<]*)<'
LIST_TAGS = ("ul", "ol")
ITEM_TAG = "li"
FILM_LINK = r"(?s)href='/filmy/detail/\?id=(\d+)'[^>]*>(.*?)</a>"
FILM_STRAND = r"(?s)<div class='other-val'>.*?</div>"
HALL_LABEL = r"(?s)<div Class='location-icon'>(.*?)</div>"
VERSION_LABEL = r"font-size: 0\.8em;'>([^<]*)<"
SHOWTIME = r'<div class="item"[^>]*title="([^"]*)"[^>]*onclick="getScreening\((\d+),[^"]*"\s*>(\d{1,2}:\d{2})<'
RUNTIME_WORD = r"(?i)minut"
SEAT_ITEM = r'(?s)(<g class="seat-item[^"]*".*?</g>)'
SEAT_TAKEN = r'^<g class="seat-item[^"]*\boccupied\b'
SEAT_PRICE = r"Cena:\s*([\d\s ]+(?:,\d+)?)"
LISTING_LINK = r'(href="/film/\d+-[^"/]+/[a-z-]*/?"[^>]*>[^<]*)<'
LISTING_ID = r'href="/film/(\d+)-'
LISTING_PATH = r'href="(/film/\d+-[^"/]+)/'
RATING_BLOCK = r'"aggregateRating"\s*:\s*\{([^}]*)\}'
RATING_VALUE = r'"ratingValue"\s*:\s*([\d.]+)'
RATING_COUNT = r'"ratingCount"\s*:\s*(\d+)'
WEEK_FILE_LINK = r"""(?i)(https?://[^"']*top20-\d{4}-\d{1,2}cz\.xlsx?)"""
ANNUAL_FILE_LINK = r"""(?i)(https?://[^"']*top50\d{4}\.xlsx?)"""
ARTICLE_LINK = r"(?i)(/top-20-cr-[a-z0-9-]+)"
# (column name, text in the header row, text below it, the lower text may go on)
WEEK_COLUMNS = (
    ("week_of_run", "Poč", "týd", True),
    ("cinemas", "Poč.", "kin", False),
    ("weekend_gross", "Víkend", "tržby", False),
    ("weekend_admissions", "Víkend", "diváci", False),
    ("total_gross", "Celkem", "tržby", False),
    ("total_admissions", "Celkem", "diváci", False),
)
WEEK_FIXED_COLUMNS = {"rank": 0, "title": 2, "distributor": 3, "country": 4}
WEEK_HEADER = (2, "Film")
WEEK_HEADER_ROWS = 12
ANNUAL_HEADER = ((0, "Poř."), (1, "Titul"))
ANNUAL_COLUMNS = {"rank": 0, "title": 1, "original_title": 2, "distributor": 3, "premiere": 5, "country": 6}
ANNUAL_LIFETIME = ("screenings", "admissions", "gross")

# A forecast is good when it is this close to the truth.
ACCURACY_TOLERANCE = 0.2
