"""URL filter: rules first, then naive Bayes over the words of host and path.

Names run together are split by a unigram model: the Viterbi path through all letters of a name with the most probable words. A word's frequency
is its number of hosts, over all urls, and names that are more frequent words run together count as those words.

The classifier is multinomial naive Bayes. It learns from all distinct hosts and paths, counted in the executors: a url that a rule fits has that rule's
verdict as its label; of the others, those with a word of SEEDS are unwanted, and the rest count as wanted with the weight UNLABELLED. So it carries
the rules over to urls that none fits, by the words that they share with those that one fits. The probability of the unwanted class takes the words
of a url once each, so that a name said twice is no stronger evidence.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, most_frequent, table

#: (host, path, verdict); a rule fits its host and all subdomains if the url's path starts with the rule's, and the longest wins.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Words that mark unwanted sites where no rule fits.
SEEDS = ("adult", "ads", "bet", "bets", "casino", "cheap", "gamble", "gambling", "loan", "loans", "pills", "poker", "porn", "sex", "spam", "viagra", "xxx")
#: Weight of a url that neither a rule nor a seed labels, as a wanted one.
UNLABELLED = 0.5
#: Words of the unigram model (the size of the model: the most frequent, the others are unknown words to it), letters of a word, and words with a weight, besides the seeds.
WORDS, LONGEST, WEIGHTS = 100_000, 24, 200_000
#: Fewest letters of the words that a counted name is taken apart into.
SHORTEST = 3
THRESHOLD = 0.5
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NAME = re.compile(r"[^\W\d_]+|\d+")


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


class Rules:
    def __init__(self, rules):
        self.by: dict[str, list[tuple[str, str]]] = {}
        for h, p, verdict in rules:
            self.by.setdefault(h, []).append((p, verdict))

    def find(self, host_: str, path_: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest that fits; an equally long one that blocks goes before one that allows."""
        found, at = None, 0
        while True:
            name = host_[at:]
            for p, verdict in self.by.get(name, ()):
                if path_.startswith(p):
                    key = (len(name) + len(p), verdict == "block", name + p, verdict)
                    found = max(found, key) if found else key
            at = host_.find(".", at) + 1
            if not at:
                return (found[2], found[3]) if found else (None, None)


class Segmenter:
    """Splits letters into the most probable words; unknown words cost ten times more with each letter."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self.cost = {w: float(np.log(total / n)) for w, n in counts.items()}
        self.unknown = float(np.log(total))
        self.longest = min(LONGEST, max(map(len, counts), default=1))

    def _words(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        for i in range(1, len(name) + 1):
            cost, at = min((best[j] + self.cost.get(name[j:i], self.unknown + 2.302585 * (i - j)), j) for j in range(max(0, i - self.longest), i))
            best.append(cost)
            back.append(at)
        out, i = [], len(name)
        while i:
            out.append(name[back[i] : i])
            i = back[i]
        return out[::-1]

    def __call__(self, text: str) -> list[str]:
        """Words of a text; of a number its first digit, and a 0 for each further one up to four digits."""
        out = []
        for name in _NAME.findall(text.lower()):
            if name[0].isdecimal():
                out.append(name[0] + "0" * min(len(name) - 1, 3))
            else:
                out += self._words(name)
        return out


def split_counts(counts: dict[str, int], whole=()) -> dict[str, int]:
    """Counts without the names that are other words run together; their counts go to those words. Words of ``whole`` stay.

    A name goes if its best split without itself has only known words of SHORTEST letters or more, and either each of these is as frequent as
    the name, or the name saves less, over its uses, than its letters cost as a word of the model.
    """
    counts = dict(counts)
    model, keep = Segmenter(counts), set(whole)
    for w in sorted(counts, key=lambda w: (-len(w), w)):
        own = model.cost.get(w)
        if w in keep or len(w) < 2 * SHORTEST:
            continue
        del model.cost[w]
        parts, n = model._words(w), counts[w]
        known = len(parts) > 1 and all(len(x) >= SHORTEST and x in model.cost for x in parts)
        saved = n * (sum(model.cost[x] for x in parts) - own) if known else 0
        if known and (min(counts[x] for x in parts) >= n or saved < model.unknown + 2.302585 * len(w)):
            del counts[w]
            for x in parts:
                counts[x] += n
        else:
            model.cost[w] = own
    return counts


class Bayes:
    """Multinomial naive Bayes on two classes, with one added to every count."""

    def __init__(self, counts: dict, urls: tuple[float, float] = (0, 0), words: tuple[float, float] = (0, 0), size: int = 0):
        """From weighted counts of words as (wanted, unwanted), of urls and of all words so too, and the number of distinct words."""
        self.prior = float(np.log((urls[1] + 1) / (urls[0] + 1)))
        totals = [n + size + 1 for n in words]
        self.weight = {w: float(np.log((bad + 1) / totals[1]) - np.log((good + 1) / totals[0])) for w, (good, bad) in counts.items()}

    def score(self, words: list[str]) -> float:
        """Probability of the unwanted class; words not seen in training say nothing."""
        odds = self.prior + sum(self.weight.get(w, 0.0) for w in words)
        return float(1 / (1 + np.exp(-np.clip(odds, -700, 700))))


class Filter:
    def __init__(self, rules, segmenter: Segmenter, bayes: Bayes):
        self.rules, self.segmenter, self.bayes, self.seen = Rules(rules), segmenter, bayes, {}

    def words(self, host_: str, path_: str) -> list[str]:
        """The distinct words, marked as the host's or the path's, in order."""
        if host_ not in self.seen:
            if len(self.seen) > 100_000 or len(host_) > 1_000:
                self.seen.clear()
            self.seen[host_] = [f"h:{w}" for w in dict.fromkeys(self.segmenter(host_))]
        return self.seen[host_] + [f"p:{w}" for w in dict.fromkeys(self.segmenter(path_))]

    def label(self, host_: str, path_: str, words: list[str], seeds: set) -> int:
        """1 unwanted, 0 wanted, -1 neither known."""
        verdict = self.rules.find(host_, path_)[1]
        if verdict:
            return int(verdict == "block")
        return 1 if not seeds.isdisjoint(w[2:] for w in words) or not seeds.isdisjoint(_NAME.findall(f"{host_}/{path_}".lower())) else -1


def fit(urls: DataFrame, rules=RULES, seeds=SEEDS, words: int = WORDS) -> Filter:
    """urls: host, path. Words count once a host, over all rows, and names run together count as their words; training on all distinct (host, path)."""
    spark = urls.sparkSession
    scratch = Scratch(spark)
    names = F.regexp_extract_all(F.lower(F.concat_ws("/", "host", "path")), F.lit(r"(\p{L}+)"), 1)
    found = urls.select("host", F.explode(names).alias("token")).where(F.length("token") <= LONGEST).distinct()
    found = scratch.save(found.groupBy("token").agg(F.count("*").alias("n")))
    counts = {r.token: r.n for r in most_frequent(found, words)}
    scratch.drop(found)
    for w in seeds:
        counts[w] = max(counts.get(w, 0), 2)
    made = Filter(rules, Segmenter(split_counts(counts, seeds)), Bayes({}))
    kinds = "token string, bad double, good double, bad_urls double, good_urls double"
    found = urls.distinct().mapInArrow(_class_counts(spark.sparkContext.broadcast((made, set(seeds)))), kinds)
    found = found.groupBy("token").agg(*(F.sum(c).alias(c) for c in ("bad", "good", "bad_urls", "good_urls")), F.ceil(F.sum(F.col("bad") + F.col("good"))).alias("n"))
    found = scratch.save(found)
    docs = found.where("token is null").first()
    every = found.where("token is not null")
    always = [f"{k}:{w}" for k in "hp" for w in seeds]
    rows = [*most_frequent(every, WEIGHTS), *every.where(F.col("token").isin(always)).collect()]
    size, bad, good = every.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    if docs:
        made.bayes = Bayes({r.token: (r.good, r.bad) for r in rows}, (docs.good_urls, docs.bad_urls), (good, bad), size)
    scratch.close()
    return made


def _class_counts(state):
    """Words with their weighted counts in unwanted and in wanted urls; a null word has the weights of urls."""

    def run(batches):
        made, seeds = state.value
        for b in batches:
            counts, urls = (Counter(), Counter(), Counter()), [0, 0, 0]
            for h, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = made.words(h, p)
                label = made.label(h, p, words, seeds)
                counts[label].update(words)
                urls[label] += 1
            good, bad, rest = counts
            words = [*{**good, **bad, **rest}]
            zeros = [0.0] * len(words)
            cols = [[*map(float, map(bad.__getitem__, words)), 0.0], [*(good[w] + UNLABELLED * rest[w] for w in words), 0.0], [*zeros, float(urls[1])], [*zeros, urls[0] + UNLABELLED * urls[2]]]
            yield pa.RecordBatch.from_arrays([pa.array([*words, None], pa.string()), *(pa.array(c, pa.float64()) for c in cols)], ["token", "bad", "good", "bad_urls", "good_urls"])

    return run


def _judge(filter_):
    def run(batches):
        f = filter_.value
        for b in batches:
            rows = []
            for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                rule, verdict = f.rules.find(h, p)
                score = f.bayes.score(f.words(h, p))
                rows.append((rule, verdict or ("block" if score >= THRESHOLD else "allow"), score))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], [*b.schema.names, "rule", "verdict", "score"])

    return run


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, seeds=SEEDS) -> DataFrame:
    """A row for every row: page_id, host, path, rule (null if none fits), verdict (allow or block), score (of the method).

    A null url or one without :// has empty host and path; no rule with a path fits it and its verdict is the method's on no words. Very long
    urls are read whole. Equally long rules that disagree: the one that blocks wins. Rows repeat as often as they come in, though a host and
    path teaches once; a null id stays null. Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    made = pages.sparkSession.sparkContext.broadcast(fit(urls.select("host", "path"), rules, seeds))
    return urls.mapInArrow(_judge(made), "page_id long, host string, path string, rule string, verdict string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
