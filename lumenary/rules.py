"""Rule data: word lists, patterns, thresholds and weights that results depend on."""

from __future__ import annotations

UNKNOWN = "unknown"

# sources
DEFAULT_URLS = [
    "https://blog.google/technology/health/google-research-healthcare-ai/",
    "https://blog.google/technology/health/how-were-using-ai-to-help-transform-healthcare/",
    "https://blog.google/innovation-and-ai/technology/health/google-ai-and-health/3-predictions-for-ai-in-healthcare-in-2024/",
    "https://www.youtube.com/watch?v=cdXzR-cmmkc",
    "https://www.youtube.com/watch?v=Ivn4Gi0aCfc",
    "https://pubmed.ncbi.nlm.nih.gov/39801619/",
]
VIDEO_URL = r"(youtube\.com|youtu\.be|youtube-nocookie\.com|m\.youtube\.com)"
ARTICLE_URL = r"(pubmed\.ncbi\.nlm\.nih\.gov|ncbi\.nlm\.nih\.gov/pubmed)"
SOURCE_TYPES = ["blog", "youtube", "pubmed"]

# Text filters
NOISE_PHRASES = [
    "related posts", "subscribe", "cookie", "privacy policy", "terms of service", "advertisement", "sponsored",
    "newsletter", "sign up", "follow us", "share this", "comments", "leave a reply",
]
NOISE_MIN_CHARS = 20
BOILERPLATE = [
    r"(cookie|privacy|terms of service|subscribe|newsletter|sign.?up)",
    r"(advertisement|sponsored|promoted|follow us|share this)",
    r"(all rights reserved|copyright \d{4})",
    r"(related posts|recommended for you|you may also like)",
    r"(leave a reply|leave a comment|comments are closed)",
]
BOILERPLATE_MIN_CHARS = 15
NEAR_DUPLICATE_CHARS = 50
DESCRIPTION_LINE_CHARS = 10
FALLBACK_PARAGRAPH_CHARS = 30
LANGUAGE_MIN_CHARS = 20

# Chunks and transcripts
MIN_CHUNK, MAX_CHUNK = 50, 1500
TRANSCRIPT_BLOCK = 200
SENTENCES_PER_GROUP = 3

# topics
TOP_K_TAGS, SIMILARITY_THRESHOLD = 5, 0.35
TOPICS = [
    ("artificial intelligence", "artificial intelligence, AI systems, intelligent agents, automation, cognitive computing"),
    ("machine learning", "machine learning, supervised learning, unsupervised learning, neural networks, model training, prediction"),
    ("deep learning", "deep learning, convolutional neural networks, recurrent networks, transformers, neural architecture"),
    ("natural language processing", "natural language processing, NLP, text analysis, language models, sentiment analysis, tokenization"),
    ("healthcare", "healthcare, medicine, hospitals, patient care, healthcare systems, medical services, clinical practice"),
    ("medical research", "medical research, clinical trials, biomedical studies, drug discovery, epidemiology, public health research"),
    ("clinical medicine", "clinical medicine, diagnosis, treatment, patient outcomes, medical procedures, clinical decision support"),
    ("public health", "public health, disease prevention, health policy, vaccination, epidemiology, population health"),
    ("data science", "data science, data analysis, statistics, data visualization, exploratory analysis, big data"),
    ("web scraping", "web scraping, HTML parsing, crawling, web data extraction, data collection from websites"),
    ("data engineering", "data engineering, data pipelines, ETL, data warehousing, data infrastructure, data processing"),
    ("information retrieval", "information retrieval, search engines, document indexing, ranking, query processing, semantic search"),
    ("education", "education, learning, teaching, online courses, e-learning, academic instruction, training"),
    ("cybersecurity", "cybersecurity, network security, encryption, threat detection, vulnerability, information security"),
    ("software engineering", "software engineering, software development, programming, code quality, testing, DevOps, architecture"),
    ("robotics", "robotics, autonomous systems, robotic process automation, drones, mechatronics, actuators"),
    ("finance", "finance, fintech, banking, investment, trading, financial markets, economic analysis"),
    ("climate and environment", "climate change, environment, sustainability, renewable energy, carbon emissions, ecology"),
    ("biotechnology", "biotechnology, genetic engineering, genomics, bioinformatics, synthetic biology, CRISPR"),
    ("ethics and policy", "ethics, AI ethics, technology policy, regulation, governance, fairness, bias, responsible AI"),
]
MEDICAL_TAGS = ["healthcare", "medical research", "clinical medicine", "public health", "biotechnology"]
DISCLAIMERS = [
    "not a substitute for medical advice", "not medical advice", "consult a qualified physician", "consult your doctor",
    "consult a healthcare professional", "informational purposes only", "educational purposes only",
    "does not constitute medical advice", "seek professional medical advice", "speak with your healthcare provider",
]
ABSTRACT_KEYWORDS = ["background:", "methods:", "results:", "conclusions:", "objective:", "introduction:", "discussion:", "purpose:"]

# authors
WEAK_AUTHORS = [
    "admin", "administrator", "staff", "editor", "team", "guest", "contributor", "anonymous", "unknown", "user", "by",
    "author", "news desk", "editorial team", "web editor",
]
TRUSTED_CHANNELS = [
    "google", "google health", "google deepmind", "ted", "tedx", "ted-ed", "kurzgesagt", "veritasium", "3blue1brown",
    "minutephysics", "scishow", "healthcare triage", "osmosis", "khan academy", "freecodecamp", "mit opencourseware",
    "stanford", "harvard", "mayo clinic", "cleveland clinic", "johns hopkins", "world health organization", "who", "nih", "cdc",
]
INSTITUTIONAL = [
    "university", "institute", "hospital", "foundation", "research", "laboratory", "center", "centre", "association",
    "society", "journal", "clinic", "medical", "health", "academy", "college", "school", "organization", "organisation",
    "department",
]
CORPORATE = [
    "google", "microsoft", "meta", "apple", "amazon", "nvidia", "openai", "deepmind", "ibm", "intel", "samsung", "oracle",
    "salesforce",
]

# Domains, best tier first; a name counts wherever it stands in the host
DOMAIN_TIERS = [
    (1.0, [
        "pubmed.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov", "nih.gov", "cdc.gov", "fda.gov", "who.int", "nature.com",
        "science.org", "thelancet.com", "nejm.org", "bmj.com", "ieee.org", "acm.org", "springer.com", "elsevier.com",
        "wiley.com", "plos.org", "cell.com",
    ]),
    (0.85, [
        "blog.google", "ai.googleblog.com", "research.google", "deepmind.google", "openai.com", "microsoft.com",
        "research.microsoft.com", "engineering.fb.com", "meta.com", "aws.amazon.com", "developer.nvidia.com",
        "blogs.nvidia.com", "ibm.com", "apple.com",
    ]),
    (0.8, [
        ".edu", ".ac.uk", ".ac.in", "arxiv.org", "bbc.com", "bbc.co.uk", "reuters.com", "apnews.com", "nytimes.com",
        "washingtonpost.com", "theguardian.com", "wired.com", "arstechnica.com", "techcrunch.com", "theverge.com",
    ]),
    (0.75, [
        "healthline.com", "mayoclinic.org", "webmd.com", "clevelandclinic.org", "medscape.com", "sciencedaily.com",
        "livescience.com", "towardsdatascience.com", "medium.com",
    ]),
    (0.6, ["youtube.com", "youtu.be"]),
    (0.2, ["blogspot.com", "wordpress.com"]),
]
TOP_SUFFIXES = [".gov", ".edu"]
DOMAIN_DEFAULTS = {"pubmed": 0.7, "youtube": 0.5}
DOMAIN_OTHER, DOMAIN_NO_URL = 0.4, 0.3

# regions
US_HOSTS = ["nih.gov", "pubmed.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov", "cdc.gov", "fda.gov"]
GLOBAL_HOSTS = ["youtube.com", "youtu.be", "medium.com", "wordpress.com", "blogspot.com", "github.com", "wikipedia.org", "arxiv.org"]
SUFFIX_REGIONS = {
    ".uk": "UK", ".co.uk": "UK", ".in": "India", ".co.in": "India", ".de": "Germany", ".fr": "France", ".jp": "Japan",
    ".cn": "China", ".au": "Australia", ".ca": "Canada", ".br": "Brazil", ".ru": "Russia", ".it": "Italy", ".es": "Spain",
    ".nl": "Netherlands", ".kr": "South Korea", ".se": "Sweden", ".ch": "Switzerland", ".gov": "US", ".edu": "US", ".mil": "US",
}

# Recency as (years up to which, score), score beyond; score of a missing date
RECENCY = {
    "pubmed": ([(2, 1.0), (5, 0.85), (10, 0.7)], 0.5, 0.6),
    "youtube": ([(0.5, 1.0), (1, 0.9), (2, 0.75), (3, 0.55)], 0.3, 0.3),
    "blog": ([(1, 1.0), (2, 0.85), (3, 0.7), (5, 0.5)], 0.3, 0.4),
}
RECENCY_UNPARSED = 0.4

# Weights of author, content, domain, recency, disclaimer
WEIGHTS = {
    "blog": (0.20, 0.15, 0.30, 0.20, 0.15),
    "youtube": (0.35, 0.05, 0.05, 0.30, 0.25),
    "pubmed": (0.30, 0.25, 0.15, 0.15, 0.15),
}

# Languages: frequent words, most frequent first, and the scripts that name a language by themselves
LANGUAGE_WORDS = {
    "en": "the of and to in is that for it with as was on are be this by from at or have an not which but you they we their has been more can will its were",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus ne se ce avec il sont aux ou son mais nous cette ont été sa comme elle leur",
    "es": "de la que el en y los del se las por un para con una no su al lo como más es o pero sus le ha este sí porque esta son entre está cuando muy sin sobre ser",
    "pt": "de a que o e do da em um para com não uma os no se na por mais as dos como mas ao foi das tem à seu sua ou ser quando muito há nos já está são também",
    "it": "di che e la il un a per in una è non sono del si con i le da della dei nel alla più come anche ma gli ha al lo delle questo o nella essere stato suo",
    "nl": "de van het een en in is dat op te zijn met voor niet aan er om ook als dan maar bij of uit nog naar heeft worden door wordt deze hij over ze kan",
    "sv": "och i att det som en på är av för med till den har de inte om ett han men var jag sig från vi så kan man när år under också eller efter vid",
    "da": "og i at det er en til af på for med den de som der ikke har et var han fra jeg om sig men kan man vil blev efter også eller ved være hun når",
    "no": "og i det er på en til som av for at med de har ikke den et var om fra han jeg men seg kan så ble etter også vi eller ved være når hun",
    "fi": "ja on ei se että oli hän mutta ovat myös kun niin joka tai kuin sen ole mukaan vain jos nyt ollut sekä tämä he me mitä jo",
    "pl": "i w na z do się nie że to jest o jak za od po dla przez są oraz ale tym był co jego czy które przy może już być tylko ich",
    "cs": "a v se na je že s z do o to i ve za jako pro by po od byl ale jeho které podle jsou také který jsem když tak jen více",
    "tr": "ve bir bu da de için ile çok olarak olan daha gibi ne en kadar sonra ise var değil ama her veya olduğu o göre ancak tarafından",
    "ro": "de și în a la cu pe o un din nu că este pentru care mai sau au se fost ca prin ce sunt dar după fi lui între",
    "hu": "a az és hogy nem is egy volt meg ez csak de ha már van mint el vagy még azt nagyon lehet ki aki minden kell",
    "id": "yang dan di dengan untuk ini dari dalam tidak itu pada adalah akan oleh ke sebagai juga karena dapat tersebut atau telah mereka ada",
    "vi": "và của là có được trong cho các một người với những không đã này để khi từ đến về như ra cũng tại năm",
    "ru": "и в не на что с по как это он к а из у от за но так же для его все было только мы она был бы они то",
    "uk": "і в на що не з та до у як це за він від а для його про але був або так також які є бути після",
    "bg": "на и в за от се да не е с по са че като до това при или който беше той има след още ще бъде",
    "ar": "في من على أن إلى التي عن مع هذا ما كان الذي هذه لا بين كما بعد أو قد ذلك",
    "fa": "و در به از که این را با است برای آن یک خود تا بر هم شد بود شده اما",
}
LANGUAGE_SCRIPTS = {"ja": "\u3040-\u30ff", "ko": "\uac00-\ud7af\u1100-\u11ff", "zh-cn": "\u4e00-\u9fff", "th": "\u0e00-\u0e7f", "el": "\u0370-\u03ff", "he": "\u0590-\u05ff",
                    "hi": "\u0900-\u097f", "bn": "\u0980-\u09ff", "ta": "\u0b80-\u0bff", "te": "\u0c00-\u0c7f"}
