"""URL filter: rules first; else words cut from host names by unigram Viterbi, scored by multinomial naive Bayes.

Host and path are split off by built-in functions, and rules (host, path) fit a host and all its subdomains
where the path starts with the rule's; the longest rule wins.

Where no rule fits, the host's labels are split at signs and digits and each part into words: the split
of the highest product of unigram probabilities, words that the dictionary lacks paying for their length. The words of the host and of
the path are scored by naive Bayes. There are no labelled URLs, so the two classes are taught by words: a URL whose
host has a seed word is an example to block, any other an example to allow; every word that goes along with them
then has its say. Word and class counts are taken over all rows, and every word counts: the FREQUENT most frequent words (and
the fixed ones) are broadcast, rarer ones are tables that hosts and rows are joined with.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType

from .common import materialize

#: words of the dictionary and of the classifier that are broadcast, each; all others are joined
FREQUENT = 50_000
#: letters of the longest word that the dictionary has
LONGEST = 24

# fixed values: words of unwanted hosts that the classifier starts from, and common words of host names
BLOCK_WORDS = ("spam", "casino", "pills", "bets", "betting", "poker", "porn", "adult", "sex", "viagra", "loan", "ads", "track", "tracker", "malware", "phishing", "lottery", "jackpot", "xxx")
COMMON_WORDS = ("www", "blog", "news", "shop", "store", "mail", "free", "cheap", "win", "farm", "best", "buy", "online", "home", "world", "example", "web", "site", "page", "my", "the", "and", "for", "book", "game", "play", "music", "photo", "video", "mobile")

#: a tuple per rule: verdict, host, start of the path
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end. No ://: both empty."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


class Words:
    """A unigram dictionary of words with their numbers; split() gives the most probable words of a run of letters.

    total is the whole dictionary's, of which counts may be a part; rare gives the numbers of further words.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = total or sum(counts.values()) or 1
        self.cost = {w: -math.log(n / self.total) for w, n in counts.items()}
        self.unknown = math.log(self.total) + 2.0
        self.split = lru_cache(maxsize=100_000)(self._split)

    def __reduce__(self):
        return _words, (self.cost, self.total)

    def _split(self, run: str, rare: dict[str, int] | None = None) -> tuple[str, ...]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(run) + 1):
            options = []
            for start in range(max(0, end - LONGEST), end):
                part = run[start:end]
                cost = self.cost.get(part)
                if cost is None and rare and part in rare:
                    cost = -math.log(rare[part] / self.total)
                if cost is None:  # an unknown word: dear, and dearer by each letter
                    cost = self.unknown + 2.5 * len(part)
                options.append((best[start][0] + cost, start))
            best.append(min(options))
        out, end = [], len(run)
        while end:
            start = best[end][1]
            out.append(run[start:end])
            end = start
        return tuple(reversed(out))

    def lacking(self, host: str) -> set[str]:
        """Parts of the host's runs that may be words but are not held here."""
        runs = {run for label in host.split(".")[:-1] for run in _RUNS.findall(label)}
        return {run[i:j] for run in runs for i in range(len(run)) for j in range(i + 2, min(len(run), i + LONGEST) + 1) if run[i:j] not in self.cost}


def _words(cost, total) -> Words:
    w = Words({}, total)
    w.cost = cost
    return w


_RUNS = re.compile(r"[^\W\d_]+")


def tokens(host: str, path: str, words: Words, rare: dict[str, int] | None = None) -> list[str]:
    """Words of the host, its last label marked as such, and words of the path; figures count as one token."""
    *labels, last = (host or "").split(".")
    out = [w for label in labels for run in _RUNS.findall(label) for w in (words._split(run, rare) if rare else words.split(run))]
    out += ["." + last] if last else []
    out += ["/" + r for r in _RUNS.findall((path or "").lower())]
    if re.search(r"\d", path or ""):
        out.append("/0")
    return out


def dictionary(hosts: DataFrame) -> DataFrame:
    """w, n: runs of letters of all hosts' labels with their numbers of hosts (once per host, however many rows it has), and the fixed words."""
    runs = hosts.select(F.explode(F.array_distinct(F.split(F.regexp_replace("host", "[^\\p{L}]+", " "), " "))).alias("w")).where(f"length(w) between 2 and {LONGEST}")
    found = materialize(runs.groupBy("w").agg(F.count("*").alias("n")), "url-runs")
    floor = max(2, (found.agg(F.sum("n")).first()[0] or 0) // 1000)
    fixed = BLOCK_WORDS + COMMON_WORDS
    counts = {w: floor for w in fixed} | {r.w: r.n + floor for r in found.where(F.col("w").isin(*fixed)).collect()}
    known = Words(counts)

    @F.pandas_udf(BooleanType())
    def made_of_fixed(runs: pd.Series) -> pd.Series:  # such a run is no word of its own
        return pd.Series([len(parts := known._split(w)) > 1 and all(p in known.cost for p in parts) for w in runs], dtype=bool)

    others = found.where(~F.col("w").isin(*fixed)).where(~made_of_fixed("w"))
    return others.unionByName(hosts.sparkSession.createDataFrame(list(counts.items()), "w string, n long"))


def _frequent(table: DataFrame, word: str, n: Column, frequent: int, always: tuple[str, ...]) -> tuple[list, DataFrame | None]:
    """The rows of the most frequent words and of those in always, collected; the others, or None where there are none."""
    key = F.struct(F.col(word).isin(*always).alias("a"), n.alias("n"), F.col(word).alias("w"))
    most = table.withColumn("__key", key).orderBy(F.desc("__key")).limit(frequent + 1).collect()
    if len(most) <= frequent:
        return most, None
    last = most.pop()["__key"]
    return most, table.where(key <= F.struct(F.lit(last["a"]).alias("a"), F.lit(last["n"]).alias("n"), F.lit(last["w"]).alias("w")))


def judge(pages: DataFrame, url_col: str = "url", *, rules=RULES, frequent: int = FREQUENT, smooth: float = 1.0) -> DataFrame:
    """pages with host, path, rule (null: none), verdict and score (log odds to block; null where a rule decides).

    A null URL, or one without ://, has an empty host and path and no words: the method then allows it. Columns of
    pages with these names are replaced. frequent decides what is broadcast, not the result.
    """
    spark = pages.sparkSession
    host, path = host_and_path(url_col)
    split = pages.withColumns({"host": host, "path": path})
    hosts = materialize(split.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    words = materialize(dictionary(hosts), "url-dictionary")
    most, rare_words = _frequent(words, "w", F.col("n"), frequent, BLOCK_WORDS + COMMON_WORDS)
    total = words.agg(F.sum("n")).first()[0]
    shared = spark.sparkContext.broadcast(Words({r.w: r.n for r in most}, total))  # `frequent` words

    @F.pandas_udf(ArrayType(StringType()))
    def lacking(hosts: pd.Series) -> pd.Series:
        return pd.Series([sorted(shared.value.lacking(h)) for h in hosts])

    @F.pandas_udf(ArrayType(StringType()))
    def words_of(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([tokens(h, p, shared.value) for h, p in zip(hosts, paths, strict=True)])

    @F.pandas_udf(ArrayType(StringType()))
    def words_with(hosts: pd.Series, paths: pd.Series, rare: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([tokens(h, p, shared.value, dict(zip(r, k, strict=True)) if r is not None else None) for h, p, r, k in zip(hosts, paths, rare, n, strict=True)])

    # a path's figures do not matter to its tokens, so rows fold to few kinds before any token is made
    kind = F.regexp_replace(F.regexp_replace("path", "[^\\p{L}\\p{N}]+", "/"), "[0-9]+", "0")
    kinds = split.groupBy("host", kind.alias("path")).agg(F.count("*").alias("n"))
    if rare_words is None:
        told = kinds.withColumn("tokens", words_of("host", "path"))
    else:
        parts = hosts.select("host", F.explode(lacking("host")).alias("w")).join(rare_words, "w")
        parts = parts.groupBy("host").agg(F.collect_list(F.struct("w", "n")).alias("rare"))  # at most one host's parts
        told = kinds.join(materialize(parts, "url-rare-words"), "host", "left").withColumn("tokens", words_with("host", "path", "rare.w", "rare.n")).drop("rare")
    told = materialize(told, "url-tokens")
    seed = F.arrays_overlap(F.coalesce("tokens", F.array().cast("array<string>")), F.array(*map(F.lit, BLOCK_WORDS)))
    classes = told.select("tokens", "n", seed.cast("long").alias("y"))
    totals = {r.y: r.n for r in classes.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    per = classes.select("y", "n", F.explode("tokens").alias("t")).groupBy("t").agg(F.sum(F.col("n") * F.col("y")).alias("block"), F.sum(F.col("n") * (1 - F.col("y"))).alias("allow"))
    per = materialize(per, "url-token-counts")
    block_all, allow_all, v = per.agg(F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0)), F.count("*") + 1).first()

    def odds(block: int, allow: int) -> float:
        return math.log((block + smooth) / (block_all + smooth * v)) - math.log((allow + smooth) / (allow_all + smooth * v))

    most, rare_tokens = _frequent(per, "t", F.col("block") + F.col("allow"), frequent, BLOCK_WORDS)
    prior = math.log((totals.get(1, 0) + smooth) / (totals.get(0, 0) + smooth))
    model = spark.sparkContext.broadcast({r.t: odds(r.block, r.allow) for r in most})

    @F.pandas_udf(DoubleType())
    def weight(block: pd.Series, allow: pd.Series) -> pd.Series:
        return pd.Series([odds(b, a) for b, a in zip(block, allow, strict=True)], dtype="float64")

    @F.pandas_udf(DoubleType())
    def score_of(lists: pd.Series) -> pd.Series:
        return pd.Series([prior + math.fsum(model.value.get(t, 0.0) for t in one) for one in lists], dtype="float64")

    @F.pandas_udf(ArrayType(StringType()))
    def others_of(lists: pd.Series) -> pd.Series:
        return pd.Series([[t for t in one if t not in model.value] for one in lists])

    scores = told.select("host", F.col("path").alias("kind"), score_of("tokens").alias("known"))
    if rare_tokens is not None:
        rest = told.select("host", F.col("path").alias("kind"), F.explode(others_of("tokens")).alias("t"))
        rest = rest.join(rare_tokens.select("t", weight("block", "allow").alias("w")), "t").groupBy("host", "kind").agg(F.array_sort(F.collect_list("w")).alias("ws"))
        rest = rest.select("host", "kind", F.aggregate("ws", F.lit(0.0), lambda a, x: a + x).alias("more"))  # sorted: the same sum in every run
        scores = scores.join(rest, ["host", "kind"], "left").withColumn("known", F.col("known") + F.coalesce("more", F.lit(0.0))).drop("more")
    scores = materialize(scores.where("host <> '' or kind <> ''"), "url-scores")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    # rows that need no score have keys of their own, dealt over all tasks
    needs = F.col("rule").isNull() & ((F.col("host") != "") | (F.col("path") != ""))
    out = split.withColumns({"rule": rule, "verdict": verdict}).withColumn("__kind", kind)
    out = out.withColumn("__host", F.when(needs, F.col("host")).otherwise(F.concat(F.lit(" /"), F.monotonically_increasing_id().cast("string"))))
    out = out.join(scores.select(F.col("host").alias("__host"), F.col("kind").alias("__kind"), "known"), ["__host", "__kind"], "left")
    out = out.withColumn("score", F.when(F.col("rule").isNull(), F.coalesce("known", F.lit(-1.0)))).drop("__host", "__kind", "known")
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") > 0, "block").otherwise("allow")))
