"""Scalar column functions of ingest and reporting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space of any script, the separators of ASCII too.
WHITE = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def text_key(text: Column) -> Column:
    """First 16 hex digits of the MD5 of the text, stripped, lower-cased, with white space collapsed."""
    return F.substring(F.md5(F.lower(F.trim(F.regexp_replace(text, WHITE, " ")))), 1, 16)


def model_of_dataset(dataset: Column) -> Column:
    """`x/details_<org>__<name>` -> `<org>/<name>`: the first `__` separates; null if there is none."""
    parts = [F.regexp_extract(dataset, r"^[^/]*/details_(.*?)__(.*)$", k) for k in (1, 2)]
    return F.when(parts[1] != "", F.concat_ws("/", *parts))


def parents(card: Column, tags: Column) -> Column:
    """Sorted distinct parent ids: of the card's list if it has any, else of the `base_model:` tags; the part behind the
    last `:` counts if it has a slash."""
    listed = F.when(F.size(F.coalesce(card, F.array().cast("array<string>"))) > 0, card)
    tagged = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.startswith("base_model:"))
    names = F.transform(F.coalesce(listed, tagged), lambda t: F.trim(F.element_at(F.split(t, ":"), -1)))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: F.instr(n, "/") > 0)))


#: Base families that a model name can show, first match wins, words that hint at a merge, and the beginnings
#: of errors after which a file is tried again.
FAMILIES = [
    ("llama-3", r"llama[-_ ]?3"),
    ("llama-2", r"llama[-_ ]?2"),
    ("codellama", r"code[-_]?llama"),
    ("mistral", r"mistral"),
    ("mixtral", r"mixtral"),
    ("qwen", r"qwen"),
    ("yi", r"\byi[-_]"),
    ("falcon", r"falcon"),
    ("mpt", r"\bmpt[-_]"),
    ("pythia", r"pythia"),
    ("gpt-neox", r"neox"),
    ("gpt-j", r"gpt[-_]?j"),
    ("gpt2", r"gpt2"),
    ("bloom", r"bloom"),
    ("opt", r"\bopt[-_]\d"),
    ("phi", r"\bphi[-_]?\d"),
    ("gemma", r"gemma"),
    ("solar", r"solar"),
    ("zephyr", r"zephyr"),
    ("vicuna", r"vicuna"),
    ("openchat", r"openchat"),
    ("tinyllama", r"tinyllama"),
    ("stablelm", r"stablelm"),
    ("deepseek", r"deepseek"),
    ("olmo", r"olmo"),
]
MERGE = r"merge|slerp|dare|ties|frankenstein|moe|lazymergekit|slice"
RETRYABLE = ("http:429", "http:5", "ConnectionError", "ReadTimeout", "Timeout")


def family(name: Column, ladder: list[tuple[str, str]] = FAMILIES, other: str = "unattributed") -> Column:
    out = F.when(F.lit(False), F.lit(other))
    for label, pattern in ladder:
        out = out.when(F.lower(name).rlike(pattern), F.lit(label))
    return out.otherwise(F.lit(other))


def is_merge(name: Column, pattern: str = MERGE) -> Column:
    return F.lower(name).rlike(pattern)


def month(day: Column) -> Column:
    """yyyy-MM of an ISO day as text; '' when missing."""
    return F.coalesce(F.substring(day, 1, 7), F.lit(""))


def sigmoid(x: Column, clip: float | None = None) -> Column:
    x = x if clip is None else F.greatest(F.least(x, F.lit(clip)), F.lit(-clip))
    return 1 / (1 + F.exp(-x))


def logit(p: Column, eps: float = 1e-9) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.ln(p / (1 - p))


def first_argmax(values: Column, most: int = 8) -> Column:
    """0-based place of the largest of 2 to `most` finite numbers, the first of equal ones; -1 otherwise."""
    good = F.size(values).between(2, most) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.when(good, F.array_position(values, F.array_max(values)).cast("int") - 1), F.lit(-1))


def analytic_floor(m: Column) -> Column:
    return 1 / F.sqrt(m - 3)


def effect_size(observed: Column, mean: Column, sd: Column) -> Column:
    return (observed - mean) / F.nullif(sd, F.lit(0.0))


def move_factor(a: Column, b: Column) -> Column:
    return F.greatest(a / F.nullif(b, F.lit(0.0)), b / F.nullif(a, F.lit(0.0)))


def http_code(error: Column) -> Column:
    return F.when(F.regexp_extract(error, r"^http:(\d+)", 1) != "", F.regexp_extract(error, r"^http:(\d+)", 1).cast("int"))


def retryable(error: Column) -> Column:
    out = F.lit(False)
    for prefix in RETRYABLE:
        out = out | error.startswith(prefix)
    return out
