"""Word lists and thresholds of the history and retrieval operators."""

# Words that say nothing about the content of a commit subject.
SUBJECT_STOPWORDS = [
    "the", "a", "an", "and", "or", "to", "of", "in", "for", "on", "with", "fix", "add", "update", "chore", "docs", "init", "merge", "pull", "request", "branch",
    "test", "tests", "new", "use", "into", "from", "this", "that", "not",
]

# Words that say nothing in a question.
QUESTION_STOPWORDS = [
    "the", "a", "an", "and", "or", "to", "of", "in", "for", "on", "with",
    "什么", "哪些", "怎么", "如何", "我的", "我", "的", "了", "是", "在", "有", "哪个", "那些", "请", "帮我", "最近", "在忙", "正在", "一下", "情况",
]

# Patterns of terms (Latin words and runs of CJK ideographs).
SUBJECT_TERM = r"[a-z][a-z0-9_-]{2,}|[\x{4e00}-\x{9fff}]{2,}"
QUESTION_TERM = r"[a-z][a-z0-9_-]{1,}|[\x{4e00}-\x{9fff}]{2,}"

# Limits and weights.
TOP_FILES, TOP_TERMS, STAGE_TERMS, QUERY_TERMS = 10, 5, 8, 8
EVIDENCE, SNIPPET, EVIDENCE_KEY = 8, 200, 50
MAX_COMMITS = 3000
HOT_SHARE, HOT_ADDED_WITH_SHARE, HOT_ADDED, HOT_COMMITS = 0.15, 300, 2000, 3
FEATURE_WEIGHTS = {"dir": 2.0, "dep": 2.0, "term": 1.0}
THETA, MIN_BUCKET_COMMITS, MAX_MERGE_SPAN, MIN_STAGE_BUCKETS = 0.6, 2, 3, 2
