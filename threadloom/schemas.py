"""Relations, payloads, caps and weights of the history engine. Fixed values stand here as they are."""

from __future__ import annotations

from pyspark.sql import types as T

# -- caps and weights (fixed values) ---------------------------------------------------------------------------------

MAX_HITS = 10
MAX_SNIPPET = 400
MAX_SNIPPET_COMPACT = 160
MAX_HITS_PER_THREAD = 3
MAX_COMMENTS = 10
MAX_BODY, BODY_GRACE = 800, 80
MAX_OUTLINE, OUTLINE_SNIPPET = 100, 60
MAX_CLAIMS = 10
MAX_PEOPLE = 8
MAX_THREADS = 5
MAX_LEGS, MAX_PER_KIND = 6, 2
MAX_ANY_TERMS = 24
MAX_GREP, MAX_GREP_LINE = 500, 300
MAX_COPIES = 200
MAX_CHUNK = 6000
MAX_ERROR = 300
RRF_K = 60
OVERFETCH = 30
WEIGHTS = {"error": 3.0, "test": 3.0, "symbol": 1.5, "file": 1.0, "lexical": 1.0}
HALF_LIFE_DAYS = {"failure": 548.0, "precedent": 1461.0, "rationale": None}
DECAY_ENABLED = False
BM25_K1, BM25_B = 1.2, 0.75
CHUNKING_VERSION = 1
KINDS = ("failure", "precedent", "rationale")
TRUST = ("authoritative", "reported", "machine")
HUMAN = ("authoritative", "reported")
ENGAGEMENT = ("issue_comment", "review", "review_comment")
FILE_SOURCES = ("changed", "comment", "mentioned")

# -- relations --------------------------------------------------------------------------------------------------------

_S, _L, _I, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


THREADS = _struct(repo=_S, number=_L, thread_type=_S, title=_S, author=_S, state=_S, url=_S, created_at=_TS, updated_at=_TS, closed_at=_TS, merged_at=_TS)
DOCUMENTS = _struct(
    repo=_S, number=_L, source_type=_S, source_id=_L, chunk_index=_I, author=_S, author_is_bot=_B, trust=_S, url=_S, body_markdown=_S, body_text=_S, content_hash=_S, created_at=_TS, updated_at=_TS
)
FILES = _struct(repo=_S, number=_L, path=_S, change_type=_S, source=_S)
SYMBOLS = _struct(repo=_S, number=_L, symbol=_S, path=_S, symbol_type=_S)
ERRORS = _struct(repo=_S, number=_L, exception_type=_S, message_norm=_S)
TESTS = _struct(repo=_S, number=_L, test_id=_S, test_function=_S)
COMMITS = _struct(repo=_S, number=_L, sha=_S, message=_S)
LINKS = _struct(repo=_S, number=_L, relationship=_S, target_number=_L, resolved=_B)
HISTORY = _struct(repo=_S, number=_L, source_type=_S, source_id=_L, chunk_index=_I, body_text=_S, content_hash=_S, superseded_at=_TS, reason=_S)
SYNC_STATE = T.StructType([T.StructField("repo", _S), T.StructField("pass", _S), T.StructField("high_water", _TS), T.StructField("cursor", _L), T.StructField("last_run_at", _TS)])
RAW = _struct(repo=_S, object_type=_S, object_id=_S, thread_number=_L, payload=_S, fetched_at=_TS, updated_at=_TS)

# -- payloads ---------------------------------------------------------------------------------------------------------

_USER = _struct(login=_S, id=_L, type=_S)
THREAD_PAYLOAD = _struct(
    number=_L, title=_S, body=_S, state=_S, user=_USER, author_association=_S, labels=T.ArrayType(_struct(name=_S)), created_at=_S, updated_at=_S, closed_at=_S, html_url=_S,
    pull_request=_struct(html_url=_S, merged_at=_S), merged_at=_S, state_reason=_S, closed_by=_struct(login=_S), requested_reviewers=T.ArrayType(_struct(login=_S)),
)
COMMENT_PAYLOAD = _struct(id=_L, body=_S, user=_USER, author_association=_S, created_at=_S, updated_at=_S, html_url=_S, issue_url=_S, pull_request_url=_S)
REVIEW_COMMENT_PAYLOAD = _struct(
    id=_L, body=_S, user=_USER, author_association=_S, created_at=_S, updated_at=_S, html_url=_S, pull_request_url=_S, path=_S, line=_I, original_line=_I, start_line=_I, side=_S, diff_hunk=_S,
    commit_id=_S, in_reply_to_id=_L, pull_request_review_id=_L, subject_type=_S,
)
REVIEW_PAYLOAD = _struct(id=_L, body=_S, state=_S, user=_USER, author_association=_S, submitted_at=_S, commit_id=_S, html_url=_S)
_NAMED = _struct(login=_S)
DETAIL_PAYLOAD = _struct(
    number=_L, mergedAt=_S, mergedBy=_NAMED,
    reviews=_struct(totalCount=_I, nodes=T.ArrayType(_struct(databaseId=_L, body=_S, state=_S, submittedAt=_S, url=_S, authorAssociation=_S, author=T.StructType([T.StructField("login", _S), T.StructField("__typename", _S)]), commit=_struct(oid=_S)))),
    files=_struct(totalCount=_I, nodes=T.ArrayType(_struct(path=_S, changeType=_S))),
    commits=_struct(totalCount=_I, nodes=T.ArrayType(_struct(commit=_struct(oid=_S, messageHeadline=_S)))),
    closingIssuesReferences=_struct(nodes=T.ArrayType(_struct(number=_L, repository=_struct(nameWithOwner=_S)))),
    truncated_files=_B, truncated_commits=_B,
)

#: English words that full text leaves out, after the Snowball list.
ENGLISH_STOPWORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her",
    "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
)
