"""Word lists and constants that results depend on. All tables here are short."""

# Stop words of the analyzer.
STOP_WORDS = """a about above after again all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from
further get got had has have having he her here hers herself him himself his how if in into is it its itself just me might more most must my myself no nor not now of off on once only or other our
ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where
which while who whom why will with would you your yours yourself yourselves""".split()

# Stop words of the query language.
QUERY_STOP_WORDS = frozenset(
    """a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought used to of in for on with at by from as into through during
    before after above below between out off over under again further then once and but or nor not so yet both either neither each every all any few more most other some such no only own same
    than too very just because if when where how what which who whom this that these those i me my we our you your he him his she her it its they them their""".split()
)

# Synonyms of query terms.
SYNONYMS = {
    "javascript": ["js", "ecmascript"], "js": ["javascript"], "ecmascript": ["javascript"], "python": ["py"], "py": ["python"], "typescript": ["ts"], "ts": ["typescript"],
    "golang": ["go language"], "csharp": ["c#", "c sharp"], "cpp": ["c++"], "ruby": ["rb"], "rb": ["ruby"], "machine learning": ["ml", "deep learning"], "ml": ["machine learning"],
    "artificial intelligence": ["ai"], "ai": ["artificial intelligence"], "api": ["application programming interface", "rest api", "web api"], "database": ["db", "data base"], "db": ["database"],
    "frontend": ["front-end", "front end"], "backend": ["back-end", "back end"], "devops": ["dev ops"], "ui": ["user interface"], "ux": ["user experience"], "os": ["operating system"], "cpu": ["processor"],
    "gpu": ["graphics card", "graphics processing unit"], "ram": ["memory"], "ssd": ["solid state drive"], "hdd": ["hard drive"], "html": ["hypertext markup language"], "css": ["cascading style sheets"],
    "sql": ["structured query language"], "nosql": ["non-relational database"], "cli": ["command line"], "gui": ["graphical user interface"],
}

# Suffixes and words of entities.
ORGANISATIONS = "Inc Corp Corporation LLC Ltd Company Institute Foundation Association University College Department Agency Bureau Ministry Council Commission Group Network".split()
PLACES = "City State Country Province County District Region Island Mountain River Street Avenue Boulevard Road Square Valley".split()
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
DATE_PATTERNS = [r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", r"\b\d{4}-\d{2}-\d{2}\b", rf"\b{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b", rf"\b\d{{1,2}}\s+{_MONTH}\s+\d{{4}}\b"]

# Topics and content classes by their words.
TOPICS = {
    "technology": ["computer", "software", "hardware", "internet", "digital", "tech", "machine learning", "programming", "code", "data", "cybersecurity", "algorithm", "database", "cloud", "api"],
    "science": ["research", "study", "experiment", "scientific", "theory", "discovery", "analysis", "hypothesis", "evidence", "journal", "physics", "chemistry", "biology"],
    "health": ["medical", "health", "doctor", "patient", "disease", "treatment", "medicine", "hospital", "clinic", "diagnosis", "therapy", "symptom"],
    "business": ["market", "business", "company", "corporate", "finance", "economy", "trade", "investment", "profit", "revenue", "startup", "enterprise"],
    "education": ["education", "school", "university", "student", "teacher", "learning", "course", "academic", "degree", "curriculum"],
    "politics": ["government", "political", "election", "policy", "law", "legislation", "congress", "parliament", "president", "democracy"],
    "news": ["breaking", "reported", "announced", "confirmed", "sources", "journalist", "press", "media", "coverage", "update"],
    "security": ["security", "threat", "vulnerability", "hack", "breach", "attack", "defense", "protection", "encryption", "privacy"],
}
CLASSES = {
    "technology": ["software", "programming", "computer", "algorithm", "database", "api", "cloud", "machine learning", "artificial intelligence"],
    "news": ["breaking", "reported", "announced", "today", "yesterday", "sources say", "according to"],
    "education": ["learn", "tutorial", "course", "lesson", "guide", "how to", "introduction", "basics"],
    "finance": ["stock", "invest", "market", "trading", "crypto", "bitcoin", "financial", "banking"],
    "security_privacy": ["security", "privacy", "encryption", "vulnerability", "hack", "breach", "protect"],
}
# Language profiles (code, least number of hits, marks), the first of equals wins.
LANGUAGE_PROFILES = [
    ("ja", 4, "の に は を た が で て と し れ さ".split()),
    ("zh", 4, "的 是 在 了 不 和 有 这 人 我 他 她".split()),
    ("ko", 4, "의 이 는 을 를 에 와 한 가 으로".split()),
    ("ar", 4, "في من على إلى أن هذا التي هو كان".split()),
    ("hi", 4, "का है में की को और एक यह से".split()),
    ("ru", 3, "что это как для его она они был при все".split()),
    ("pt", 4, [f" {w} " for w in "os uma são como com mais para não das dos".split()]),
    ("fr", 4, [f" {w} " for w in "les des une est dans pour avec sur sont pas".split()]),
    ("de", 4, [f" {w} " for w in "die der und den ist ein nicht sich mit auf".split()]),
    ("it", 4, [f" {w} " for w in "gli una sono della nella anche come questo quello".split()]),
    ("es", 4, [f" {w} " for w in "el la los las es en que de por una".split()]),
    ("nl", 4, [f" {w} " for w in "het een van zijn niet voor met ook maar".split()]),
    ("tr", 3, [f" {w} " for w in "bir için olan ile gibi daha çok ancak".split()]),
    ("pl", 3, [f" {w} " for w in "nie się jest jak ale czy przy oraz".split()]),
]

# Phrases of the document scores.
EXPERIENCE = ["in my experience", "i have tested", "i personally", "from my experience", "having used", "i found that", "in practice", "hands-on"]
EXPERTISE = "research study analysis data statistics methodology findings evidence hypothesis conclusion experiment peer-reviewed published journal".split()
SCAM = ["send bitcoin to", "wire transfer", "western union", "money gram", "nigerian prince", "advance fee", "lottery winner", "inheritance fund"]
SPAM = ["buy now", "free money", "click here", "act now", "limited time", "no obligation", "winner", "congratulations", "earn money", "work from home", "make money", "get rich", "casino", "viagra", "weight loss", "as seen on", "call now", "apply online", "double your", "extra income", "be your own boss"]
SCHOLARLY = ["study", "research", "analysis", "findings", "methodology", "peer-reviewed", "published", "journal", "abstract", "conclusion", "literature review", "meta-analysis", "sample size", "statistical"]
CREDENTIALS = ["ph.d", "phd", "m.d.", "dr.", "professor", "prof.", "researcher", "scientist", "engineer", "architect"]
AFFILIATIONS = ["university", "institute", "laboratory", "research center", "hospital", "college", "academy", "foundation"]
AUTHORITY = ["in my research", "i have published", "my work", "our study", "our findings", "we demonstrate", "our team"]
TIME_SENSITIVE = ["breaking", "latest", "new", "update", "released", "announced", "today", "yesterday", "this week", "this month", "just in", "developing", "exclusive", "report", "confirms", "launches"]
EVERGREEN = ["guide", "tutorial", "how to", "introduction", "basics", "overview", "getting started", "reference", "handbook", "fundamentals", "complete guide", "step by step", "best practices", "definition", "what is", "beginner"]
DATE_WORDS = "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday 2020 2021 2022 2023 2024 2025 2026".split()
POOR_TITLES = ["click here", "buy now", "free money"]

# URL parameters and suffixes.
STRIPPED_PARAMS = "fbclid gclid msclkid mc_cid mc_eid _ga _gl zanpid dclid".split()
TRACKING_PARAMS = "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid sessionid sid jsessionid phpsessid ref source clickid".split()
SKIP_SUFFIXES = ".pdf .doc .docx .xls .xlsx .ppt .pptx .zip .rar .tar .gz .jpg .jpeg .png .gif .svg .webp .ico .css .js .xml .json .rss .atom .mp3 .mp4 .avi .mov .wmv".split()
GENERIC_ANCHORS = ["click here", "here", "link", "read more", "more", "this", "source", "learn more", "details"]

# Query intent.
NAVIGATIONAL = ["login", "sign in", "signin", "log in", "sign up", "signup", "homepage", "home page", "official site", "official website"]
INFORMATIONAL = ["how to", "what is", "what are", "why do", "why does", "why is", "when did", "when does", "when is", "where is", "where do", "who is", "who are", "which is", "can i", "can you", "how do", "how does", "how can", "how much", "how many", "what does", "what do", "is it", "are there", "explain", "define", "meaning of", "definition of", "difference between", "tutorial", "guide"]
TRANSACTIONAL = ["buy", "purchase", "price", "pricing", "cost", "cheap", "discount", "deal", "coupon", "promo", "subscribe", "download", "install", "order", "shop", "store", "sale", "free trial", "register", "book", "reserve", "rent", "hire"]
LOCAL = ["near me", "nearby", "closest", "directions to", "open now", "hours of", "located in", "address of"]
BRANDS = "google facebook youtube twitter amazon github reddit wikipedia instagram linkedin netflix spotify stackoverflow microsoft apple gmail outlook twitch discord slack figma notion vercel heroku docker gitlab bitbucket npm pypi whatsapp telegram tiktok".split()
