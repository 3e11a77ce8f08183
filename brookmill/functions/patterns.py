"""Patterns and word lists that results depend on. All are in the syntax that Java's and RE2's regular expressions share."""

# They must equal the reference behaviour for equal results.
NEWS_META = r"""(?i)og:type"\s+content="(?:article|news)|"@type"\s*:\s*"(?:News|Blog|Reportage)?(?:Article|BlogPosting)"|property="article:published_time\""""
ACADEMIC_URLS = ("arxiv.org/abs/", "arxiv.org/pdf/", "papers.", "proceedings.", "doi.org/10.", "/paper/", "pubmed", "scholar")
LATEX = r"\\begin\{|\\cite\{|\\ref\{|\\usepackage"
REPOSITORY_URLS = ("gitlab.com", "bitbucket.org")
DOCUMENTATION_URLS = ("docs.", "/docs/", "readthedocs", "documentation")
ARTICLE_MARKS = ("<article", 'role="article"', 'class="post', 'class="entry', 'class="blog', "blog-post", "post-content")
FORUM_MARKS = ("forum", "thread", "discussion", "topic", "board")
PRODUCT = r"\$\d+\.\d{2}|price|add.to.cart|buy.now|sku"
LISTING_MARKS = ("search result", "items found", "sort by", "filter by")
COLLECTION = r"gallery|grid|masonry|card"
BOT_BLOCK = (
    r"just a moment|checking your browser|cf-browser-verification|enable javascript|please enable cookies|attention required|"
    r"captcha|ddos-guard|_cf_chl_opt|cloudflare|access denied|request blocked|security check|browser verification|human verification|client challenge"
)
CHALLENGE = r"just a moment|checking your browser|cf-browser-verification|enable javascript|please enable cookies|attention required!|captcha|ddos-guard|_cf_chl_opt"
JS_REQUIRED = (
    r"(?i)acm\.org|springer\.com|ieee\.org|sciencedirect\.com|nature\.com/articles|cell\.com|nejm\.org|thelancet\.com|"
    r"pubmed\.ncbi\.nlm\.nih\.gov|sci-hub\.|medium\.com|substack\.com|dev\.to|hashnode\.dev"
)
STATIC_SITES = (
    r"(?i)docs\.python\.org|readthedocs\.io|doc\.rust-lang\.org|wikipedia\.org|stackoverflow\.com|stackexchange\.com|docs\.docker\.com|"
    r"kubernetes\.io/docs|manpages\.|\.mdn\.|pubmed\.ncbi\.nlm\.nih\.gov|arxiv\.org/abs/|arxiv\.org/pdf/"
)
SPA = r"""(?i)<div\s+id="(?:root|app|__next|__nuxt)"|react-root|vue-app|angular-app|<script\s+src="[^"]*(?:react|vue|angular|svelte)[^"]*\.js"""
SCHOLARLY_LD = r"""["']@type["']\s*:\s*["'](?:scholarlyarticle|medicalscholarlyarticle)["']"""
BOILERPLATE_LINE = (
    r"(?i)^(?:share (?:this|on)|follow us|read (?:more|next)|related(?: (?:articles|stories|posts|reading))?|advertisement|sign (?:in|up)|log ?in|"
    r"subscribe|newsletter|most (?:read|popular)|more from|image (?:caption|source)|photo(?:graph)?:|credit:|getty|reuters|associated press|click here|"
    r"tags?:|filed under|posted in|categories:|comments?|leave a (?:reply|comment)|\d+ min(?:ute)? read|updated:|published:|by [A-Z][a-z]+ [A-Z][a-z]+\s*$|"
    r"copyright|all rights reserved|terms (?:of|&)|privacy policy|cookie)\b"
)
LINE_PREFIX = r"^[\s>#*+\-]*"
WIKI_EDIT = r"(?i)\[\s*edit(?:\s*\|\s*edit source)?\s*\]"
MATH_MARKUP = r"""(?i)<math\b|class\s*=\s*["'][^"']*(?:katex|mathjax)|data-(?:mathml|latex)\s*="""
MD_HEADING = r"(?m)^\s{0,3}#{1,6}\s+\S"
MD_LIST_ITEM = r"(?m)^\s*(?:[-+*]|\d+[.)])\s+\S"
MD_TABLE = r"(?im)^\s*\|?.+\|.+\n\s*\|?\s*:?-{3,}|<table\b"
MD_CODE = r"(?m)```|~~~|^(?: {4}|\t)\S"
MD_MATH = r"(?i)\$\$|\\\(|\\\[|<math\b|(?:^|[^\\])\$[^$\n]+\$"
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"
UNSAFE_HTML = r"(?i)<\s*(?:script|style|iframe|object|embed)\b"
WORD = r"[\p{L}\p{M}\p{N}_]+"
TOKEN = r"[\p{L}\p{M}\p{N}]+"
INVISIBLE = r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<noscript\b[^>]*>.*?</noscript>|<template\b[^>]*>.*?</template>"
INVISIBLE_JS = r"(?is)<(?:script|style|template|noscript|svg)\b[^>]*>.*?</(?:script|style|template|noscript|svg)>"
RAW_DROP = r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<noscript\b[^>]*>.*?</noscript>|<template\b[^>]*>.*?</template>|<head\b[^>]*>.*?</head>|<svg\b[^>]*>.*?</svg>"
LINK = r"""(?i)<a\b[^>]*\bhref=["']([^"'#]+)["']"""
CODE_BLOCK = r"(?is)<pre[^>]*>\s*<code[^>]*>(.*?)</code>\s*</pre>"

SPA_SHELL_VISIBLE_MOST = 200
SCAN_MOST = 100_000
TEXT_MOST = 500_000
TRUNCATED = "\n\n[content truncated at configured limit]"
STRATEGY_RANK = {
    "rs-trafilatura": 6, "documentation": 5, "github-readme": 5, "github-thread": 5, "github-tree": 5, "github-commit": 5, "github-commit-partial": 5,
    "github-compare": 5, "github-compare-partial": 5, "github-release": 5, "trafilatura": 4, "readability": 3, "markdownify": 2, "raw_lxml": 0,
}
CLEAN_STRATEGIES = (
    "trafilatura", "readability", "documentation", "github-readme", "github-thread", "github-tree", "github-commit", "github-commit-partial",
    "github-compare", "github-compare-partial", "github-release",
)
