"""Engine settings and the fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

#: Characters of the signatures of retrieved chunks, and of those that queries return; documents are compared by whole texts.
SIGNATURE = 800


@dataclass(frozen=True)
class EngineConfig:
    near_dup_docs: float = 0.90
    near_dup_chunks: float = 0.92
    near_dup_blocks: float = 0.96
    min_signature: int = 80
    image_threshold: float = 0.5
    text_weight: float = 0.5
    chunk_size: int = 400
    chunks_per_doc: int = 3
    top_k: int = 5
    candidate_k: int = 10
    images_per_doc: int = 3
    max_page_images: int = 20
    preview: int = 800
    excerpt: int = 500
    min_text: int = 300
    cache_ttl: int = 604_800
    cache_schema: int = 8
    max_rounds: int = 3
    max_parse_failures: int = 3
    max_queries: int = 3


# Tracking parameters that canonical URLs lose.
TRACKING_KEYS = ["fbclid", "gclid", "gbraid", "wbraid", "igshid", "mc_cid", "mc_eid", "spm", "from", "ref", "source"]

# Provider errors that mean an empty result.
NO_RESULTS = ["hasn't returned any results for this query", "didn't return any results for this query", "no results"]

# Words of questions whose answer changes with time.
DYNAMIC_TERMS = ["award", "won", "win", "season", "festival", "released", "release", "launched", "launch", "currently", "current", "ceo", "partner", "mvp", "finals", "conference finals", "champions league", "computex", "eurovision", "cannes", "bafta", "pulitzer", "2025", "2026"]

# Image URL rules.
IMAGE_EXTENSIONS = [".apng", ".avif", ".bmp", ".jpeg", ".jpg", ".png", ".webp"]
IGNORED_IMAGE_TOKENS = ["favicon", "siteicon", "site_icon", "qrcode", "barcode", "background", "bgr_", "bg_", "/bg", "button", "channel_tag", "navleft", "navright", "/qr", "-qr", "_qr", "/icon", "-icon", "_icon", "icon.", "sprite", "logo", "blank.", "spacer.", "pixel.", "tracking"]

# Boilerplate patterns.
BOILERPLATE = ["all rights reserved", "copyright", "privacy policy", "terms of (use|service)", "cookie", "subscribe", "sign in", "log in", "follow us", "share this", "advertisement", "sponsored", "read more", "recommended", "related articles", "版权", "版权声明", "免责声明", "隐私政策", "用户协议", "广告", "登录", "注册", "分享", "关注我们", "相关推荐", "相关阅读", "推荐阅读", "扫码", "微信", "客服", "备案号", "责任编辑"]
NAV_WORDS = ["home", "menu", "search", "login", "登录", "首页", "更多", "返回"]
LISTING_TOKENS = ["advertisement", "latest news", "more from", "most popular", "recommended", "related articles", "share this", "subscribe", "trending", "上一篇", "下一篇", "广告", "更多", "热门", "相关", "推荐", "相关阅读", "推荐阅读"]

# Source reliability.
TRUSTED_TOKENS = ["apnews", "bbc", "congress", "fact-sheet", "fact_sheet", "official", "reuters", "state.gov", "whitehouse", "who.int"]
WEAK_TOKENS = ["forum", "bbs", "toutiao", "weibo", "zhihu", "wordpress"]

# The router's term lists.
VISUAL = ["image", "picture", "photo", "screenshot", "figure", "diagram", "chart", "plot", "graph", "table", "slide", "page", "document", "pdf", "attachment", "scan", "poster", "form", "invoice", "receipt", "report", "paper"]
SPATIAL = ["top left", "top right", "bottom left", "bottom right", "upper left", "upper right", "lower left", "lower right", "left side", "right side", "above", "below", "next to", "beside", "near", "inside the box", "red box", "blue box", "highlighted", "circled", "arrow", "marked", "annotated", "first row", "second row", "third row", "first column", "second column", "third column"]
DEICTIC = ["this image", "this picture", "this photo", "this screenshot", "this chart", "this graph", "this table", "this figure", "this document", "this pdf", "this page", "this slide", "this report", "this paper", "the attached", "the above", "the following image", "shown here", "in the image", "in the screenshot", "in the figure", "in the table", "in the document", "on this page"]
EVIDENCE = ["according to", "based on", "using the provided", "use the provided", "from the document", "from the image", "from the table", "cite", "citation", "source", "evidence", "reference", "quote", "where does it say", "which page", "page number", "find in", "search for", "look up", "retrieve"]
FRESH = ["latest", "current", "currently", "today", "this year", "recent", "newest", "updated", "price", "pricing", "policy", "law", "regulation", "news", "release date", "version", "benchmark", "revenue", "earnings", "market share"]
TRANSFORM = ["translate", "rewrite", "rephrase", "paraphrase", "polish", "proofread", "edit", "make it more formal", "make it more casual", "shorten", "expand", "summarize this text", "summarise this text"]
SUMMARY = ["summarize", "summarise", "extract key points", "extract keywords", "classify this text", "sentiment", "identify the tone"]
CREATIVE = ["write", "draft", "compose", "generate", "create", "brainstorm", "come up with", "give me ideas", "make a list of", "suggest names", "write an email", "write a poem", "write a story", "write a post"]
CODE = ["python", "javascript", "typescript", "java", "c++", "sql", "regex", "function", "algorithm", "code", "implement", "debug", "error", "exception", "stack trace"]
REPO_WORDS = ["repo", "repository", "readme", "notebook", "log file"]
MATH = ["calculate", "compute", "solve", "equation", "derivative", "integral", "probability", "matrix", "simplify"]
CONCEPTS = ["rag", "retrieval augmented generation", "transformer", "attention mechanism", "cross entropy", "precision", "recall", "f1 score", "overfitting", "underfitting", "linear regression", "logistic regression", "decision tree", "random forest", "gradient descent", "backpropagation", "embedding", "vector database", "semantic search", "binary search", "hash table", "dynamic programming"]

# Readable-page rules.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP_TAGS = frozenset("script style noscript svg canvas iframe form button select option nav footer aside".split())
BLOCK_TAGS = frozenset("address article blockquote dd details dialog div dl dt figcaption figure h1 h2 h3 h4 h5 h6 li main ol p pre section table td th tr ul".split())
CONTENT_ATTR = r"(?i)(^|[-_\s])(article|body|content|detail|entry|main|news|page|post|read|story|text)([-_\s]|$)"
NOISE_ATTR = r"(?i)(^|[-_\s])(ad|ads|advert|app|banner|breadcrumb|comment|cookie|copyright|login|menu|modal|nav|popup|promo|recommend|related|share|sidebar|social|subscribe|toolbar|widget)([-_\s]|$)"
IMAGE_NOISE_ATTR = r"(?i)(^|[-_\s])(ad|advert|avatar|background|banner|button|icon|logo|nav|qrcode|share|social|sprite|tracking)([-_\s]|$)"
