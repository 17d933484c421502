"""Word lists, keyword tables, thresholds and weights that results depend on."""

# English stop words of the tokenizer.
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "not", "no", "nor",
    "is", "am", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having",
    "do", "does", "did", "doing",
    "will", "would", "shall", "should", "may", "might", "must", "can", "could",
    "i", "me", "my", "mine", "myself",
    "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself",
    "she", "her", "hers", "herself",
    "it", "its", "itself",
    "we", "us", "our", "ours", "ourselves",
    "they", "them", "their", "theirs", "themselves",
    "this", "that", "these", "those",
    "what", "which", "who", "whom", "whose",
    "where", "when", "why", "how",
    "in", "on", "at", "to", "for", "of", "with", "by", "from",
    "up", "out", "off", "over", "under", "into", "through",
    "about", "between", "after", "before", "during", "without",
    "again", "further", "then", "once",
    "here", "there", "all", "each", "every", "both", "few",
    "more", "most", "other", "some", "such",
    "only", "own", "same", "so", "than", "too", "very",
    "just", "because", "as", "until", "while",
    "if", "else", "also", "any", "many", "much",
]

# Words that a query rewrite drops.
QUESTION_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "am", "be", "been", "being",
    "do", "does", "did", "can", "could", "should", "would", "will", "shall",
    "may", "might", "what", "which", "who", "whom", "whose", "when", "where",
    "why", "how", "please", "tell", "explain", "describe", "about", "of",
    "in", "on", "at", "to", "for", "and", "or", "this", "that", "these",
    "those", "it", "its", "they", "their", "there", "me", "my", "i", "you",
    "your", "we", "us", "our",
]

# Japanese question phrases that a rewrite drops, longest first.
QUESTION_PHRASES = ["について教えてください", "を教えてください", "について教えて", "とはなんですか", "とは何ですか", "とは何か", "でしょうか", "を教えて", "何ですか", "どのように", "どうやって", "ください", "どうして", "ですか", "ますか", "なぜ"]

# Topics and the keywords that mark them.
TOPICS = {
    "anime": ["anime", "animation", "manga", "character", "episode", "voice actor", "アニメ", "漫画", "マンガ", "キャラ", "声優", "作品", "魔法", "フリーレン", "放送", "話"],
    "business": ["business", "startup", "company", "customer", "revenue", "sales", "market", "企業", "会社", "ビジネス", "顧客", "売上", "経営", "営業"],
    "finance": ["finance", "stock", "stocks", "inflation", "interest", "investor", "bank", "crypto", "金融", "株", "投資", "銀行", "金利", "インフレ", "為替", "資産"],
    "technology": ["technology", "software", "data", "model", "api", "cloud", "computer", "ai", "技術", "データ", "ソフトウェア", "モデル", "API", "クラウド", "開発", "人工知能"],
    "history": ["history", "war", "ancient", "empire", "century", "歴史", "戦争", "時代", "江戸", "明治", "古代", "世界史"],
    "philosophy": ["philosophy", "ethics", "meaning", "mind", "thought", "哲学", "倫理", "意味", "思想", "心", "人生"],
    "sports": ["sports", "baseball", "soccer", "basketball", "game", "team", "スポーツ", "野球", "サッカー", "バスケ", "試合", "選手", "チーム"],
}

# Reasons that keep a chunk out.
BLOCKING_REASONS = ["empty_text", "too_short", "too_long", "missing_timestamp", "mostly_punctuation", "low_meaningful_text", "too_repetitive", "wrong_language"]

# Character classes.
JAPANESE = "\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}"
MEANINGFUL = f"[A-Za-z0-9{JAPANESE}]"
WORD = f"[A-Za-z0-9_]+|[{JAPANESE}]+"

# BM25, fusion, feedback and diversity.
K1, B, QUERY_REPEAT = 1.5, 0.75, 0.2
RRF_K = 60
DENSE_WEIGHT, LEXICAL_WEIGHT, BOTH_WEIGHT = 0.475, 0.475, 0.05
ALPHA_QUERY, BETA_GLOBAL, MAX_ADJUST, MIN_SIMILARITY, HALF_LIFE_DAYS = 0.30, 0.10, 0.35, 0.20, 30.0
NEAR_SECONDS, NEAR_JACCARD = 8.0, 0.85
