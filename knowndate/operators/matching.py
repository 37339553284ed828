"""Name matching between issuers' aliases and securities or list entries.

The score of two names is the larger of token Jaccard and the Ratcliff–Obershelp
ratio of their keys.  Pairs are found by equi-joins on small id rows, exact for any
threshold t:

* Names are reduced to distinct keys and numbered, so a name held by a third of all
  rows is matched once and no text travels with the joins.
* A key has two token sets: its words, and its numbered characters (the n-th A, the n-th
  B, ...).  Jaccard >= t needs t/(1+t) * (n+m) shared words of n and m; a ratio >= t needs
  t/2 * (n+m) matched characters, which are shared numbered characters.
* Tokens are ranked by a dictionary of their frequencies among the names, rarest first.
  Two sets of n and m tokens that share o of them must meet within the first n-o+1 and
  m-o+1, so each name is listed under (token, n, m) for every size m it may be matched
  with.  At high scores pairs of tokens of a prefix longer by one are listed instead.  What
  lies before, between and behind the shared tokens bounds the overlap once more.
* The words and a bound of the ratio are then compared exactly, and Python only scores
  pairs whose ratio can still decide.

The best names of an issuer are looked for at high scores first (``LADDER``), where few
names meet.  Only issuers that do not fill their list go on to the next lower score.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knowndate.functions.identifiers import clean
from knowndate.functions.names import (
    entity_name_key,
    key_tokens,
    list_name_key,
)
from knowndate.session import cut_lineage

_SLACK = 1e-9
#: The token sets of a key, and the score from which on two of their tokens are listed as one.
KINDS = ("words", "chars")
TWO_FROM = 0.8
#: Scores at which names without a match are searched again; any shared letter suffices at last.
WIDER = (0.6, 0.3, 0.001)
#: Scores at which issuers are searched for one after the other, down to the caller's.
LADDER = (0.9, 0.8, 0.65, 0.5)
#: Size of the frequency dictionary.  Tokens that fall into one entry share its count; only
#: the speed depends on that.
DICTIONARY = 1 << 16


class _Names:
    """Distinct keys with ids and ranked token sets: ``table`` (id, key, words, chars) and the span of their sizes."""

    def __init__(self, names: DataFrame, key: str, counts: DataFrame | None = None):
        rows = names.filter(F.col(key) != "").select(key).distinct()
        # ids have to survive recomputation, hence the checkpoints
        rows = cut_lineage(rows.select(F.monotonically_increasing_id().alias("id"), key))
        tokens = rows.select("id", key, F.explode(_token_sets(F.col(key))).alias("t")).select("id", key, "t.*")
        entry = F.pmod(F.xxhash64("kind", "token"), F.lit(DICTIONARY)).cast("int")
        tokens = tokens.withColumn("entry", entry)
        self.counts = cut_lineage(tokens.groupBy("entry").count()) if counts is None else counts
        rarity = F.struct(F.coalesce("count", F.lit(0)).alias("c"), "token")
        ranked = tokens.join(F.broadcast(self.counts), "entry", "left")  # at most DICTIONARY rows
        sets = ranked.groupBy("id", key).agg(
            *[F.sort_array(F.collect_list(F.when(F.col("kind") == kind, rarity))).alias(kind) for kind in KINDS]
        )
        self.table = cut_lineage(
            sets.select("id", key, *[F.transform(kind, lambda t: t["token"]).alias(kind) for kind in KINDS])
        )
        sizes = [f(F.size(kind)) for kind in KINDS for f in (F.min, F.max)]
        found = [n or 0 for n in self.table.agg(*sizes).first()]
        self.span = {kind: found[2 * k : 2 * k + 2] for k, kind in enumerate(KINDS)}


def _token_sets(key: Column) -> Column:
    """All tokens of a key as (kind, token).

    Words become 64-bit hashes; a collision could only add a pair, which the exact score
    then drops.  The n-th occurrence of a character is one number.
    """
    letters = F.array_sort(F.filter(F.split(key, ""), lambda c: c != ""))

    def numbered(run):
        return F.transform(
            run,
            lambda c, i: F.struct(
                F.lit("chars").alias("kind"),
                ((i + 2 - F.array_position(run, c)) * 256 + F.ascii(c)).cast("bigint").alias("token"),
            ),
        )

    words = F.transform(
        key_tokens(key), lambda t: F.struct(F.lit("words").alias("kind"), F.xxhash64(t).alias("token"))
    )
    # The one-element array binds the sorted letters, so they are not rebuilt per letter.
    return F.concat(words, F.transform(F.array(letters), numbered)[0])


def _needed(kind: str, threshold: float, sizes: Column) -> Column:
    """Shared tokens that a score of ``threshold`` takes, given the sum of both sizes."""
    share = threshold / (1 + threshold) if kind == "words" else threshold / 2
    return F.greatest(F.ceil(sizes * share - _SLACK).cast("int"), F.lit(1))


def _listed(names: _Names, kind: str, threshold: float, sizes: list, together: int) -> DataFrame:
    """(id, n, m, token, first, last): the prefix tokens for every size ``m`` within ``sizes``.

    Two sets that share o tokens share ``together`` of them within the first n-o+together of each, if o is that large;
    such tokens are listed as one, with the places of the first and the last.
    """
    reach = threshold if kind == "words" else threshold / (2 - threshold)
    rows = names.table.select("id", F.size(kind).alias("n"), F.col(kind).alias("tokens"))
    low = F.greatest(F.lit(sizes[0]), F.ceil(F.col("n") * reach - _SLACK).cast("int"))
    high = F.least(F.lit(sizes[1]), F.floor(F.col("n") / reach + _SLACK).cast("int"))
    rows = rows.withColumns({"low": low, "high": high}).filter((F.col("low") <= F.col("high")) & (F.col("n") > 0))
    needed = _needed(kind, threshold, F.col("n") + F.col("m"))
    rows = rows.withColumn("m", F.explode(F.sequence("low", "high"))).withColumn("needed", needed)
    rows = rows.filter(F.col("needed") <= F.least("n", "m"))
    token = lambda i: F.element_at("tokens", i)
    listed = lambda value, i, j: F.struct(value.alias("token"), i.alias("first"), j.alias("last"))
    one = F.transform(
        F.sequence(F.lit(1), F.col("n") - F.col("needed") + 1), lambda i: listed(token(i), i, i)
    )
    if together == 2:
        end = F.col("n") - F.col("needed") + 2
        two = F.flatten(F.transform(
            F.sequence(F.lit(1), end - 1),
            lambda i: F.transform(F.sequence(i + 1, end), lambda j: listed(F.xxhash64(token(i), token(j)), i, j)),
        ))
        one = F.when(F.col("needed") > 1, two).otherwise(one)
    return rows.select("id", "n", "m", "needed", F.explode(one).alias("t")).select("id", "n", "m", "needed", "t.*")


def _meetings(left: _Names, right: _Names, kind: str, threshold: float) -> DataFrame:
    """(a, b): ids whose prefixes meet and whose places leave room for enough shared tokens."""
    together = 2 if threshold >= TWO_FROM else 1
    a = _listed(left, kind, threshold, right.span[kind], together).select(
        F.col("id").alias("a"), "token", "n", "m", "needed", F.col("first").alias("a1"), F.col("last").alias("a2")
    )
    b = _listed(right, kind, threshold, left.span[kind], together).select(
        F.col("id").alias("b"), "token", F.col("m").alias("n"), F.col("n").alias("m"),
        F.col("first").alias("b1"), F.col("last").alias("b2"),
    )
    # tokens before the first, the listed ones, those between them and those behind the last
    ends = F.when(F.col("a1") < F.col("a2"), F.least(F.col("a2") - F.col("a1"), F.col("b2") - F.col("b1"))).otherwise(0)
    room = F.least("a1", "b1") + ends + F.least(F.col("n") - F.col("a2"), F.col("m") - F.col("b2"))
    return a.join(b, ["token", "n", "m"]).filter(room >= F.col("needed")).select("a", "b")


def _of_pair(a: str, matcher: SequenceMatcher) -> float:
    x, y = set(a.split()), set(matcher.b.split())
    matcher.set_seq1(a)
    return max(len(x & y) / len(x | y), matcher.ratio())


def similar_names(left: DataFrame, right: DataFrame, min_score: float) -> DataFrame:
    """All pairs of distinct keys (``alias_key``, ``name_key``) scoring at least ``min_score``."""
    names = _Names(right, "name_key")
    return _similar(_Names(left, "alias_key", names.counts), names, min_score)


def _similar(left: _Names, right: _Names, min_score: float) -> DataFrame:
    """``similar_names`` of two prepared tables."""
    tasks = int(left.table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _meetings(left, right, "words", min_score).union(_meetings(left, right, "chars", min_score))
    a = left.table.withColumnsRenamed({"id": "a", "words": "aw", "chars": "ac"})
    b = right.table.withColumnsRenamed({"id": "b", "words": "bw", "chars": "bc"})
    shared_words = F.size(F.array_intersect("aw", "bw"))
    jaccard = shared_words / (F.size("aw") + F.size("bw") - shared_words)
    bound = 2 * F.size(F.array_intersect("ac", "bc")) / (F.size("ac") + F.size("bc"))
    pairs = (
        met.distinct().join(a, "a").join(b, "b")
        .withColumns({"jaccard": jaccard, "bound": bound})
        .filter((F.col("jaccard") >= min_score - _SLACK) | (F.col("bound") >= min_score - _SLACK))
        .select("alias_key", "name_key", "jaccard", "bound")
    )
    # the ratio never passes its bound: Jaccard decides where it is as large
    decided = F.col("jaccard") >= F.col("bound")

    def score(batches):
        matcher, known = SequenceMatcher(None), None
        for batch in batches:
            batch = batch.sort_values("name_key", ignore_index=True)
            best = np.empty(len(batch))
            for k, (a, n) in enumerate(zip(batch["alias_key"], batch["name_key"])):
                if n != known:  # what SequenceMatcher knows of the second text serves many first ones
                    matcher.set_seq2(n)
                    known = n
                best[k] = _of_pair(a, matcher)
            keep = best >= min_score
            yield batch.loc[keep, ["alias_key", "name_key"]].assign(score=best[keep])

    # Scoring costs far more than moving two short texts, so pairs are spread evenly first.
    spread = pairs.repartition(tasks, "alias_key", "name_key")
    scored = spread.filter(~decided).select("alias_key", "name_key").mapInPandas(
        score, "alias_key string, name_key string, score double"
    )
    sure = spread.filter(decided & (F.col("jaccard") >= min_score))
    return scored.unionByName(sure.select("alias_key", "name_key", F.col("jaccard").alias("score")))


def _keyed_aliases(aliases: DataFrame) -> DataFrame:
    """Distinct (cik, alias) with the alias key."""
    distinct = aliases.filter(F.col("alias").isNotNull()).select("cik", "alias").distinct()
    return distinct.withColumn("alias_key", entity_name_key(F.col("alias"))).filter("alias_key <> ''")


def discover(
    aliases: DataFrame, universe: DataFrame, min_score: float = 0.72, limit: int = 10, tie_keys: bool = False
) -> DataFrame:
    """Best securities per issuer by name score: ``limit`` rows each, numbered ``rank``.

    ``aliases``: cik, alias.  ``universe``: security_id, security_name, isin,
    is_delisted, ordinal (its input order).  Order: score, delisted first, unknown
    status last, ordinal.  Among aliases of equal score the first in text order counts.
    ``top_ties``: how many securities share the issuer's best score; ``tie_keys`` adds the ``TIE_KEYS`` of them all.
    """
    keyed = cut_lineage(_keyed_aliases(aliases))
    named = universe.withColumn("name_key", entity_name_key(F.col("security_name"))).filter("name_key <> ''")
    held = cut_lineage(named.groupBy("name_key").agg(F.count(F.lit(1)).alias("__held")))
    best = cut_lineage(_best_names(keyed, held, min_score, limit))
    delisted_first = F.col("is_delisted").desc_nulls_last()
    per_name = W.partitionBy("name_key").orderBy(delisted_first, "ordinal")
    top_of_name = (
        named.withColumn("__rn", F.row_number().over(per_name))
        .filter(F.col("__rn") <= limit)
        .drop("__rn")
    )
    per_issuer = W.partitionBy("cik").orderBy(
        F.col("discovery_score").desc(), delisted_first, "ordinal"
    )
    # ties are counted over all securities, not over the rows that are returned
    ties = (
        best.join(held, "name_key")
        .groupBy("cik", "discovery_score")
        .agg(F.sum("__held").alias("n"))
        .groupBy("cik")
        .agg(F.max_by("n", "discovery_score").alias("top_ties"))
    )
    if tie_keys:
        ties = ties.join(_tie_keys(best, named), "cik")
    return (
        best.join(top_of_name, "name_key")
        .join(ties, "cik")
        .withColumn("rank", F.row_number().over(per_issuer))
        .filter(F.col("rank") <= limit)
        .select(
            "cik",
            "sec_alias",
            "security_id",
            "security_name",
            "name_key",
            "discovery_score",
            "isin",
            "is_delisted",
            "rank",
            "top_ties",
            *(TIE_KEYS if tie_keys else []),
            F.lit(True).alias("discovery_only"),
        )
    )


def _best_names(keyed: DataFrame, held: DataFrame, min_score: float, limit: int) -> DataFrame:
    """(cik, name_key, discovery_score, sec_alias): at least the names of each issuer's ``limit`` best securities.

    ``keyed``: cik, alias, alias_key.  ``held``: name_key and its number of securities.  An issuer with ``limit``
    securities at one step of the ladder needs none of the lower scores; the others are searched again.
    """
    names = _Names(held, "name_key")
    wanted, done = keyed, []
    for score in (*(s for s in LADDER if s > min_score), min_score):
        pairs = _similar(_Names(wanted, "alias_key", names.counts), names, score)
        best = cut_lineage(
            wanted.join(pairs, "alias_key")
            .groupBy("cik", "name_key")
            .agg(
                F.max("score").alias("discovery_score"),
                F.min_by("alias", F.struct((-F.col("score")).alias("s"), "alias")).alias("sec_alias"),
            )
        )
        if score == min_score:
            done.append(best)
            break
        found = best.join(held, "name_key").groupBy("cik").agg(F.sum("__held").alias("n"))
        filled = found.filter(F.col("n") >= limit).select("cik")
        done.append(best.join(filled, "cik", "left_semi"))
        wanted = cut_lineage(wanted.join(filled, "cik", "left_anti"))
        if wanted.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


#: Counts over all securities that share an issuer's best score.
TIE_KEYS = ["tied_ids", "tied_names", "tied_filled_isins", "tied_isins"]


def _tie_keys(best: DataFrame, named: DataFrame) -> DataFrame:
    """``TIE_KEYS`` per issuer: distinct ids, name keys, filled ISINs and distinct filled ISINs at the best score.

    Issuers whose best score belongs to one name take the counts of that name, made once per name; only the others
    meet the securities.
    """
    isin = F.nullif(clean(F.col("isin")), F.lit(""))
    held = named.select("name_key", F.struct("security_id").alias("__id"), isin.alias("__isin"))
    counts = [
        F.count_distinct("__id").alias("tied_ids"),
        F.count("__isin").alias("tied_filled_isins"),
        F.count_distinct("__isin").alias("tied_isins"),
    ]
    at_top = best.groupBy("cik", "discovery_score").agg(
        F.count(F.lit(1)).alias("tied_names"), F.min("name_key").alias("name_key")
    )
    at_top = at_top.groupBy("cik").agg(
        F.max_by(F.struct("discovery_score", "tied_names", "name_key"), "discovery_score").alias("t")
    ).select("cik", "t.*")
    # a name without any security is no tie; names come from the universe, so each has one
    one = at_top.filter("tied_names = 1").join(held.groupBy("name_key").agg(*counts), "name_key")
    several = (
        at_top.filter("tied_names > 1").drop("name_key")
        .join(best.select("cik", "discovery_score", "name_key"), ["cik", "discovery_score"])
        .join(held, "name_key")
        .groupBy("cik", "tied_names").agg(*counts)
    )
    return one.select("cik", *TIE_KEYS).unionByName(several.select("cik", *TIE_KEYS))


def name_coverage(
    cases: DataFrame, aliases: DataFrame, official: DataFrame, min_score: float = 0.90
) -> DataFrame:
    """Best official list entry per case and whether a normalised name matches exactly.

    Pairs are looked for at ``min_score`` first.  Only the issuers without any pair are
    looked for again at lower scores, so the best score is exact and the wide last search
    sees few names.  ``official``: cusip, issuer_name, ordinal.
    """
    keyed = _keyed_aliases(aliases.join(cases.select("cik"), "cik", "left_semi"))
    entries = (
        official.groupBy("issuer_name")
        .agg(F.min_by("cusip", "ordinal").alias("cusip"), F.min("ordinal").alias("ordinal"))
        .withColumn("name_key", entity_name_key(F.col("issuer_name")))
    )
    entries = cut_lineage(entries)
    keyed = cut_lineage(keyed)
    names = _Names(entries, "name_key")
    wanted, pairs = keyed, None
    for score in (min_score, *(s for s in WIDER if s < min_score)):
        found = cut_lineage(_similar(_Names(wanted, "alias_key", names.counts), names, score))
        pairs = found if pairs is None else pairs.union(found)
        matched = wanted.join(found.select("alias_key").distinct(), "alias_key").select("cik")
        wanted = cut_lineage(wanted.join(matched.distinct(), "cik", "left_anti"))
        if wanted.isEmpty():
            break
    # an alias may have been searched for several issuers, at several scores
    pairs = pairs.distinct()
    per_name = entries.groupBy("name_key").agg(
        F.min_by(F.struct("ordinal", "issuer_name", "cusip"), "ordinal").alias("entry")
    )
    best = (
        keyed.join(pairs, "alias_key")
        .join(per_name, "name_key")
        .groupBy("cik")
        .agg(
            F.max_by("entry", F.struct("score", (-F.col("entry.ordinal")).alias("o"))).alias("entry"),
            F.max("score").alias("best_score"),
            F.max(F.col("alias_key") == F.col("name_key")).alias("exact"),
        )
    )
    counts = aliases.filter(F.col("alias").isNotNull()).groupBy("cik").agg(
        F.count(F.lit(1)).alias("alias_count")
    )
    joined = cases.select("cik").join(counts, "cik", "left").join(best, "cik", "left")
    score = F.coalesce("best_score", F.lit(0.0))
    return joined.select(
        "cik",
        F.coalesce("alias_count", F.lit(0)).alias("alias_count"),
        score.alias("best_score"),
        F.col("entry.issuer_name").alias("best_official_name"),
        F.col("entry.cusip").alias("best_cusip"),
        F.coalesce("exact", F.lit(False)).alias("exact_normalized_name_hit"),
        (score >= min_score).alias("candidate_hit"),
    )


def name_coverage_report(coverage: DataFrame) -> DataFrame:
    hit = F.col("candidate_hit")
    return coverage.agg(
        F.count(F.lit(1)).alias("hard_cases"),
        F.count_if(hit).alias("candidate_hits"),
        F.count_if("exact_normalized_name_hit").alias("exact_normalized_name_hits"),
        F.count_distinct(F.when(hit, F.col("best_cusip"))).alias("unique_valid_cusips"),
    )


def list_hits(cases: DataFrame, aliases: DataFrame, official: DataFrame) -> DataFrame:
    """Cases × their observation quarters: do alias list keys occur in that quarter's list?

    ``cases``: cik, last_filing.  ``official``: vintage, issuer_name.  One row per
    (cik, vintage) with the number of matched keys; an equi-join on (vintage, key).
    """
    from knowndate.functions.keys import observation_quarters, quarter_label

    asked = cases.select(
        "cik", F.explode(observation_quarters(F.col("last_filing"))).alias("q")
    ).select("cik", quarter_label(F.col("q")).alias("vintage"))
    alias_keys = _keyed_aliases(aliases).select(
        "cik", list_name_key(F.col("alias_key")).alias("key")
    ).distinct()
    hits = (
        asked.join(alias_keys, "cik")
        .join(list_keys(official), ["vintage", "key"])
        .groupBy("cik", "vintage")
        .agg(F.count(F.lit(1)).alias("matched_keys"), F.min("key").alias("first_key"))
    )
    return asked.join(hits, ["cik", "vintage"], "left").select(
        "cik",
        "vintage",
        F.col("matched_keys").isNotNull().alias("exact_discovery_hit"),
        F.coalesce("matched_keys", F.lit(0)).alias("matched_keys"),
        "first_key",
    )


def list_keys(official: DataFrame) -> DataFrame:
    """Distinct (vintage, list key) of list entries."""
    names = official.select("vintage", "issuer_name").distinct()
    key = list_name_key(entity_name_key(F.col("issuer_name")))
    return names.select("vintage", key.alias("key")).filter("key <> ''").distinct()


def missing_controls(vintages: DataFrame, official: DataFrame, controls: list[str]) -> DataFrame:
    """(vintage, name) of controls absent from a list: must be empty.

    ``controls`` are a handful of issuers known to be on every list.
    """
    asked = vintages.select("vintage").distinct().select(
        "vintage", F.explode(F.array(*[F.lit(c) for c in controls])).alias("name")
    )
    asked = asked.withColumn("key", list_name_key(entity_name_key(F.col("name"))))
    return asked.join(list_keys(official), ["vintage", "key"], "left_anti").select("vintage", "name")
