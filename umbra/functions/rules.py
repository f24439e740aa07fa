"""Names, patterns, keywords and thresholds that results depend on."""

# Entity labels: code and confidence threshold.
CODES = {"p_nm": "NM", "p_ph": "PH", "p_add": "ADD", "p_rrn": "RRN", "p_em": "EM", "p_ip": "IP", "p_acn": "ACN", "p_pp": "PP"}
THRESHOLDS = {"p_nm": 0.70, "p_rrn": 0.95, "p_add": 0.70, "p_ip": 0.80, "p_ph": 0.70, "p_acn": 0.90, "p_pp": 0.75, "p_em": 0.70, "p_acct": 0.85, "p_passport": 0.90}
DEFAULT_THRESHOLD = 0.75

# Entity patterns.
EMAIL = r"[a-zA-Z0-9][a-zA-Z0-9._+-]*@[a-zA-Z0-9][a-zA-Z0-9.-]*\.[a-zA-Z]{2,}"
OCR_EMAIL = r"[a-zA-Z0-9][a-zA-Z0-9._+-]*@[a-zA-Z0-9]+(?:com|net|org|co\.?kr|kr|jp|cn|edu|gov)"
OCR_SUFFIXES = ("com", "net", "org", "co.kr", "kr", "jp", "cn", "edu", "gov", "info")
PHONES = (r"01[016789]-[0-9]{3,4}-[0-9]{4}", r"0(?:2|3[1-3]|4[1-4]|5[1-5]|6[1-4])-[0-9]{3,4}-[0-9]{4}", r"0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}", r"01[016789][0-9]{7,8}")
PHONE_METHODS = ("regex-mobile", "regex-landline", "regex-general", "regex-mobile-no-hyphen")
RRN_HYPHEN = r"[0-9]{6}-[1-4][0-9]{6}"
RRN_PLAIN = r"(?<![0-9])[0-9]{6}[1-4][0-9]{6}(?![0-9])"
IP = r"(?<![0-9])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9])"
PASSPORT = r"[a-zA-Z][0-9]{3}[a-zA-Z0-9][0-9]{4}"
ADDRESSES = (
    r"[가-힣]{2,}(?:특별시|광역시|도)\s+[가-힣]{2,}(?:시|군|구)\s+[가-힣]{2,}(?:로|길)\s+[0-9]+[가-힣0-9\s-]*",
    r"[가-힣]{2,}\s+[가-힣]{2,}(?:시|군|구)\s+[가-힣]{2,}(?:로|길)?\s*[0-9]*[가-힣0-9\s-]*",
    r"[가-힣]{2,}(?:시|군|구)\s+[가-힣]{2,}(?:로|길)\s+[0-9]+[가-힣0-9\s-]*",
    r"[가-힣]{2,}구\s+[가-힣]{2,}(?:로|길)\s+[0-9]+[가-힣0-9\s-]*",
    r"[가-힣]{2,}(?:시|구)\s+[가-힣]{2,}동(?:\s+[0-9]+)?",
)
ADDRESS_AREA, ADDRESS_PLACE = "[도시군구]", "[로길동]"

# Parts of buildings after an address, labels before a value, particles after an address, and characters that no name holds.
ADDRESS_PARTS = r"^(?:[\s,]*(?:[가-힣a-zA-Z0-9]+(?:타운|빌라|맨션|아파트|오피스텔)|[가-힣0-9]+(?:동|호|층)|[0-9-]+(?:동|호|층)?))+"
VALUE_LABELS = (
    r"(?i)^(?:주\s*소|거\s*주\s*지|Address|Addr)\s*[:.]?\s*",
    r"(?i)^(?:성\s*명|이\s*름|Name)\s*[:.]?\s*",
    r"(?i)^(?:연\s*락\s*처|Phone|Mobile|Tel)\s*[:.]?\s*",
    r"(?i)^(?:이\s*메\s*일|E-?mail)\s*[:.]?\s*",
    r"(?i)^(?:생\s*년\s*월\s*일|Birth)\s*[:.]?\s*",
    r"(?i)^(?:주\s*민\s*번\s*호|RRN)\s*[:.]?\s*",
)
ADDRESS_PARTICLE, ADDRESS_ROAD_PARTICLE = r"(?<=[0-9가-힣])(에|에서|로|으로)(\s.*)?$", r"(동|호|층|번지|[0-9])$"
NO_NAME = r"""[0-9!@#$%^&*()_+\-=\[\]{};':"\\|,.<>/?]"""

# Form fields by code, in order, and the shapes of masked values.
FIELDS = {
    "NM": ("이름", "성명", "이름(한글)", "한글성명"),
    "PH": ("전화번호", "휴대폰", "연락처", "핸드폰"),
    "ADD": ("주소", "현주소", "주소지"),
    "RRN": ("주민번호", "주민등록번호"),
    "EM": ("이메일", "이메일주소", "e-mail"),
    "BTH": ("생년월일", "생일"),
}
MASKED_SHAPES = (r"^[가-힣]\*+[가-힣]$", r"^[가-힣]\*+[가-힣]*$", r"^010[-*]*[0-9]{4}[-*]*[0-9]{4}$", r"^[0-9]{2,3}[-*]+[0-9]{3,4}[-*]+[0-9]{4}$", r"^[*]+$")

# Files by extension.
MEDIA = {
    "DOCUMENT": (".pdf", ".docx", ".doc", ".txt", ".xlsx", ".xls"),
    "PHOTO": (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp"),
    "AUDIO": (".mp3", ".wav", ".m4a", ".flac", ".ogg"),
    "VIDEO": (".mp4", ".avi", ".mov", ".mkv", ".webm"),
}

# Statement guard.
WRITE_WORDS = "drop delete truncate alter create insert update grant revoke exec execute".split()
SECRET_WORDS = "password pwd passwd secret credential token api_key encrypted_password".split()
FORBIDDEN_TABLE = "users"
REFUSAL = "보안상의 이유로 해당 정보는 제공할 수 없습니다."
PLACEHOLDER = "[민감한 정보는 보호됩니다]"

# Question tiers.
NOT_DB, NOT_DB_WORDS = r"db\s*말고|데이터베이스\s*말고", ("파일서버", "파일 서버", "파일", "file")
NOT_FILE, NOT_FILE_WORDS = r"파일\s*말고|파일서버\s*말고", ("db", "데이터베이스", "db서버", "db 서버")
LAW_QUESTIONS = r"어떤\s*법령|어떤\s*규정|어떤\s*조항|어떤\s*법|어떤\s*법률|위반할\s*수\s*있는|위반하는|위반\s*가능|위배되는|위배할"
ARTICLE_NUMBER = r"[0-9]+\s*조|제\s*[0-9]+\s*조"
OPERATION_WORDS = ("파일", "db", "데이터베이스", "서버", "이슈")
SYSTEM_WORDS = ("파일서버", "파일 서버", "파일", "db서버", "db 서버", "이슈", "스캔", "file", "server", "issue")
LAW_WORDS = ("법령", "법", "규정", "조항", "개인정보보호법")
RULE_WORDS = ("법", "규정", "조항", "법령", "개인정보보호법", "정보통신망법", "개인정보", "보호", "규칙", "지침", "가이드라인", "표준", "내용", "알려줘")
DATA_WORDS = ("고객", "매출", "통계", "데이터", "조회", "테이블", "집계", "count", "sum", "avg", "수량", "건수")
RELEVANCE, GROUNDING, SEARCH_RETRIES, GENERATION_RETRIES, MESSAGES = 0.6, 0.7, 3, 2, 2

# Query expansion by version; the last holds for every further version.
EXPANSIONS = (" 관련 법령 조항", " 법적 근거 및 규정", " 법률 규정 법령")

# Legal texts.
STRUCTURE = r"^제\s*[0-9]+\s*조(\s*의\s*[0-9]+)?(?![\p{L}\p{N}_])|^제\s*[0-9]+\s*항(?![\p{L}\p{N}_])|^[①-⑩](?![\p{L}\p{N}_])|^\(?[0-9]+\)?[.)]\s+\S+|^(부칙|별표|별지)(?![\p{L}\p{N}_])"
ARTICLE = r"^제\s*[0-9]+\s*조(\s*의\s*[0-9]+)?"
SENTENCE_END = r"[.!?」’)\]}]$|[다함됨임]\.$"
TOP_SHARE, BOTTOM_SHARE, REPEAT_SHARE = 0.08, 0.92, 0.35
REPEAT_LONGEST = 100
PIECE_LABEL = "청크 %d"

# Account numbers: bank codes, digits of the accounts of a bank, leading digits of accounts.
BANK_CODES = "001 002 003 004 005 006 007 010 011 012 020 021 022 023 024 025 026 027 031 032 034 035 037 039 045 048 050 054 055 057 060 064 071 081 083 088 089 090 092 209 218 230 240 243 247 261 262 263 264 265 266 267 269 270 278 279 280 287 290 291 292".split()
ACCOUNT_DIGITS = {
    "003": (11, 14), "004": (10, 11, 12, 14), "007": (11, 12, 14), "010": (11, 12, 13), "011": (13,), "012": (13,), "020": (13,), "023": (11,), "027": (12,), "031": (12,), "032": (13,),
    "034": (13,), "035": (10, 12), "037": (13,), "039": (13,), "071": (14,), "081": (14,), "088": (11, 12), "089": (12,), "090": (13,), "092": (13, 14),
}
ACCOUNT_PREFIXES = "3333 1000 1002 1005 1006 100 110 140 150 230 223 301 302 312 351 352 356 9 5 01 3".split()
SPECIAL_ACCOUNT = "^9[0-9]{10}$"
STRICT_MOBILE = "^01[016789]-?[0-9]{3,4}-?[0-9]{4}$"

# Names by context.
NAME_LABELS = ("성명", "한글성명", "이름")
NOT_NAMES = ("성명", "생년월일", "주소", "연락처", "이메일", "학점", "지원분야", "경력여부")
NAME_AFTER_LABEL = r"(?:이름|성명|성함)[은는이가\s]*[:\s]\s*([가-힣]{2,4})(?=[이가은는을를]|\s|[.,]|$)"
NAME_AFTER_NAME = r"Name\s*[:]\s*([가-힣a-zA-Z]{2,20})"
CONTEXT_NAME, KNOWN_NAME = (0.85, "regex_context"), 0.90  # confidence and method
MODEL = "koelectra"  # method of the model's spans
NAME_STOPS = "이가은는을를의에와과로도만씨님군양장"

# Column dictionaries.
DICTIONARY_HEADERS = ("영문약어", "한글명", "영문풀네임", "설명", "PI여부")

# Answer checks: codes of the issues are the library's own.
INCOMPLETE = r"(?i)\.\.\.$|^\.\.\.|죄송.*?답변.*?없|정보.*?없.*?제공"
INCOMPLETE_ALLOWED = ("자료 없음", "찾을 수 없")
ERRORS, ERROR_ALLOWED = "(?i)error|오류|exception|실패|failed", ("오류 없", "error.*?없")
ANSWER_LENGTHS = (10, 5000)

# Chunks of a fixed length.
CHUNK, CHUNK_REACH, CHUNK_OVERLAP, CHUNK_LEAST = 800, 100, 150, 50
CHUNK_ENDS = ".。\n!?"

# Kinds of questions, in the order in which replies are searched for them.
KINDS = ("db_query", "vector_search", "both", "general")

# Stored connections: defaults, the standing schema, databases that can be reached, and how sampled columns are judged.
FILE_PORT, FILE_SERVER, PUBLIC = 9000, "WebDAV", "public"
DBMS = {"postgresql": "PostgreSQL", "mysql": "MySQL", "oracle": "Oracle"}
UNKNOWN, NOT_ENCRYPTED, ENCRYPTED = "판단불가", "안되어있음", "되어있음"

# Replies of models: marks of a turn, lines that are read, lines of a failed parse that are skipped and kept.
TURN_MARK, TURN_END = "<|start_header_id|>assistant<|end_header_id|>", "<|eot_id|>"
ASPECTS = {"accuracy": ("정확성", "accuracy"), "completeness": ("완전성", "completeness"), "confidence": ("신뢰도", "confidence")}
ASPECT_DEFAULT = 0.5
STOPPED = "agent stopped due to iteration limit or time limit"
PARSE_FAILED = ("could not parse", "parsing error")
SKIPPED_LINES = ("error", "parsing", "could not", "output parsing", "troubleshooting", "visit:", "http", "langchain")
DATA_LINE, LINE_MARKS = r"(?i)[0-9]+|ID|Status|Detected|Issue|Count|Name|Type", r"^\*\*|\*\*$|^#+\s*|^-+\s*"
ASKED_SECRETS = ("비밀번호", "password", "pwd", "passwd", "secret", "credential", "token", "api_key", "encrypted_password")
ASKED_TABLES = ("users 테이블", "users table", "user 정보", "사용자 정보", "사용자 목록", "user list")
CONTEXT_DOCS, CONTEXT_CHARS, CONTEXT_BREAK, NO_CONTEXT = 5, 800, "\n\n---\n\n", "참고 문서 없음"
RERANK_INPUT, RERANK_KEPT = 40, 5

# Legal texts: kinds of lines, names of laws, dates.
LAW_LINES = {
    "article": r"^(제\s*[0-9]+\s*조(?:\s*의\s*[0-9]+)?)",
    "paragraph": r"^(제\s*[0-9]+\s*항|[①②③④⑤⑥⑦⑧⑨⑩])",
    "item": r"^([0-9]+(?:의[0-9]+)?)\.",
    "subitem": r"^([가-힣])\.",
}
CIRCLES = "①②③④⑤⑥⑦⑧⑨⑩"
CHUNKS_A_PAGE = 0.5
LAW_NAME, LAW_NAME_LENGTHS, LAW_HEAD_LINES = r"^([가-힣\s]+(?:법|규정|규칙|지침|지시|규정서))", (3, 50), 15
DATE = r"([0-9]{4})[.\s]([0-9]{1,2})[.\s]([0-9]{1,2})"
DATE_WORDS = ("시행", "개정", "공포")

# What a video scan reports.
VIDEO_FOUND, VIDEO_CLEAN = "개인정보가 탐지되었습니다. (얼굴: %d개, 오디오: %d개, 화면 텍스트 PII: %d개)", "개인정보가 탐지되지 않았습니다."

# Dialogues: what stands in for missing parts of a prompt, and answers that need no grounds.
TABLES_SILENT = ("DB 조회를 수행할 수 없습니다.", "DB 조회 결과 없음")
TABLES_FAILED = "DB 조회 중 오류가 발생했습니다"
TABLES_SAY_NOTHING = ("DB 조회를 수행할 수 없습니다", "DB 조회 결과 없음", "DB 조회 중 오류가 발생했습니다")
TABLES_SAY = "[DB 조회 성공] "
NO_HISTORY = "대화 이력 없음"
NO_DATA = ("자료 없음", "찾을 수 없", "정보 없", "보안상의 이유")
ANSWER_FAILED = "죄송합니다. 답변 생성 중 오류가 발생했습니다."
WARNING = "⚠️ [답변 품질 경고] "
