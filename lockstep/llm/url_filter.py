"""URL filtering by a Bloom filter cascade (DataFrame functions only).

A rule is an action and `host/path`; it fits its host and all subdomains if the url's path starts with the rule's.
Each url gives a few keys: its last 1..d host labels (d: most labels in a rule) joined with its path prefixes of the
lengths that rules have.  No other key can be a rule, so the keys of all urls are the complete universe.

For each action a cascade over that universe is built: level 0 encodes the listed keys, level 1 the keys of the corpus
that level 0 lets through by mistake, level 2 the listed keys that level 1 lets through, and so on until none is left.
Membership of any key of the corpus is then exact, and is a test of a few 64-bit words inside a projection: neither
joins nor shuffles are needed to judge a url.  The keys of a url are one array, filtered by one expression an action, so that
a level's words stand in the plan once, however many rules, labels and lengths there are.  A filter is register-blocked: one word per key and level, MASK_BITS bits
of it.  Its size follows the listed keys, not the corpus.  Rules are a list in the driver; beyond MAX_LISTED keys an action has
several cascades, each over a part of its keys, and a key is listed if one of them has it.

Cases.  A null url or one without `://` has empty host and path; no rule fits and the verdict is the default.  Among
fitting rules the longest text wins, then block before allow.  Empty tables give empty results; repeated rows are
judged each; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored, table

RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
BITS_PER_KEY = 32
MASK_BITS = 8
MAX_LISTED = 2_000_000  # of one cascade, whose words are literals of 8 MB at most


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def keys_of(host: Column, path: Column, rules: list[str]) -> Column:
    """The url's candidate keys, an array; empty where no rule can fit."""
    parts = [split_rule(r) for r in rules]
    depth = max((h.count(".") + 1 for h, _ in parts), default=0)
    lengths = F.filter(F.lit(sorted({len(p) for _, p in parts})), lambda n: n <= F.char_length(path))
    ends = F.transform(F.sequence(F.lit(1), F.lit(depth)), lambda k: F.call_function("substring_index", host, F.lit("."), -k))
    starts = F.transform(lengths, lambda n: F.call_function("substring", path, F.lit(1), n))
    keys = F.flatten(F.transform(F.array_distinct(ends), lambda e: F.transform(starts, lambda s: F.concat(e, s))))
    return F.when(host != "", F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))


def _slot(key: Column, level: int, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(2 * level)), F.lit(words))


def _mask(key: Column, level: int) -> Column:
    h = F.xxhash64(key, F.lit(2 * level + 1))
    mask = F.lit(0).cast("long")
    for i in range(MASK_BITS):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


class Cascade:
    """levels: one array of 64-bit words each, even ones of listed keys, odd ones of false positives."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels

    def passes(self, key: Column, level: int) -> Column:
        words = self.levels[level]
        word = F.get(F.lit(words), _slot(key, level, len(words)).cast("int"))
        mask = _mask(key, level)
        return word.bitwiseAND(mask) == mask

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over."""
        inside = F.lit(False)
        for level in reversed(range(len(self.levels))):
            inside = self.passes(key, level) & ~inside
        return F.coalesce(inside, F.lit(False))

    @staticmethod
    def build(listed: DataFrame, universe: DataFrame) -> Cascade:
        """listed, universe: DataFrames of `key`.  The universe is scanned once; later levels see only false positives."""
        listed = stored(listed.distinct(), "op7-listed")
        cascade = Cascade([])
        inside, others = listed, universe
        n = inside.count()
        while n:
            level = len(cascade.levels)
            words = max(1, -(-n * BITS_PER_KEY // 64))
            set_ = inside.groupBy(_slot(F.col("key"), level, words).alias("slot")).agg(F.bit_or(_mask(F.col("key"), level)).alias("word")).collect()  # at most `words` rows
            array = np.zeros(words, dtype=np.int64)
            for slot, word in set_:
                array[slot] = word
            cascade.levels.append(array)
            wrong = others.where(cascade.passes(F.col("key"), level))
            if level == 0:
                wrong = wrong.distinct().join(listed, "key", "left_anti")
            wrong = stored(wrong, "op7-false")
            inside, others, n = wrong, inside, wrong.count()
        return cascade


def _listed(spark, keys: list[str]) -> DataFrame:
    """The keys as a column of one literal."""
    return spark.range(0, 1, 1, 1).select(F.explode(F.split(F.lit("\x01".join(keys)), "\x01")).alias("key"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    texts = ["".join(split_rule(r)) for _, r in rules]
    if not rules:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    urls = urls.withColumn("keys", keys_of(F.col("host"), F.col("path"), [r for _, r in rules]))
    universe = urls.select(F.explode("keys").alias("key"))
    found = []
    for action in sorted({a for a, _ in rules}):
        mine = sorted({t for (a, _), t in zip(rules, texts, strict=True) if a == action})
        cascades = [Cascade.build(_listed(spark, mine[k : k + MAX_LISTED]), universe) for k in range(0, len(mine), MAX_LISTED)]
        hits = F.filter("keys", lambda key: reduce(Column.__or__, [c.contains(key) for c in cascades]))  # noqa: B023  used in this turn
        found.append(F.transform(hits, lambda key: F.struct(F.char_length(key).alias("size"), F.lit(action == "block").alias("first"), key.alias("rule"), F.lit(action).alias("verdict"))))  # noqa: B023
    best = urls.withColumn("best", F.array_max(F.concat(*found)))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op7_url_cascade(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT u.page_id, r.verdict, r.host || r.path AS rule,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC, r.verdict DESC) AS k
  FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM u LEFT JOIN fits f ON f.page_id = u.page_id AND f.k = 1
"""
