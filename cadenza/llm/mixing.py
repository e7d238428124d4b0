"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed into cells of (source, language, topic). A cell's weight is the product of a factor
for each of its values, its documents' probability is the weight capped at 1. The factors are
raked: for each dimension in turn a value's factor is scaled by wanted over expected tokens, where
the expected tokens count the cap, so the marginals hold for what is in fact sampled. Rounds end
when no factor changes any more, or after ROUNDS. A document is sampled if a hash of its key falls
below its probability.

A dimension's target is a share for each value, or a number: the power to which observed shares are
raised. Values without a share of their own get the share given for REST (what is left to 1 if none
is given) in proportion to their tokens. A target of 0 excludes a value. What a value can't
reach with all its tokens the others of its dimension share; `report` shows by value the share aimed
at, the one expected and the one sampled.

Only cells come to the driver, at most MOST_CELLS of them (three short labels and a sum
each); with more the same steps run on the table of cells. Both ways give the same weights.

Defined cases: a null dimension counts as the empty label; a text without words has one
token, its end; targets for values that don't occur are spread over the others; if all
values that occur have a target of 0 nothing is sampled; repeated rows of one key share
their fate, and so do equal texts without a key; an empty table gives an empty result;
columns named like the outputs are replaced.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialise

ROUNDS, BUDGET = 100, 0.5
MOST_CELLS = 1_000_000
#: Rows of (value, factor) or (cell, weight) that are broadcast at most, LABEL_BYTES each at most; longer labels go by shuffle.
MOST_BROADCAST, LABEL_BYTES = 100_000, 256
#: A factor's change in a round that counts as none.
STEADY = 1e-13
DIMS = ("source", "lang", "topic")
REST = "*"
TARGETS: dict[str, dict[str, float] | float] = {
    "source": 0.5,
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.08, REST: 0.02},
    "topic": 0.9,
}

#: Words that speak for a topic, in English, German, French and Spanish.
TOPICS = {
    "law": "law court license licence copyright contract judge legal statute recht gericht gesetz vertrag lizenz droit tribunal licence loi contrat ley juez derecho licencia contrato",
    "science": "science research physics chemistry theory experiment biology wissenschaft forschung physik chemie theorie recherche physique chimie théorie ciencia investigación física química teoría",
    "health": "health doctor hospital disease patient medicine gesundheit arzt krankenhaus krankheit medizin santé médecin hôpital maladie salud médico hospital enfermedad medicina",
    "economy": "economy market bank trade price tax company wirtschaft markt handel preis steuer firma économie marché banque commerce prix impôt economía mercado banco comercio precio impuesto",
    "technology": "software computer data network program internet algorithm rechner daten netzwerk programm ordinateur données réseau logiciel ordenador datos red programa",
    "culture": "music film theatre painting novel poem museum musik theater gemälde roman gedicht musique théâtre peinture poème musée música cine teatro pintura novela museo",
}
OTHER = "other"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = ".,;:!?)"


def _topic_words() -> dict[str, list[str]]:
    return {name: sorted(set(words.split())) for name, words in TOPICS.items()}


def described(docs: DataFrame, *columns: str) -> DataFrame:
    """columns of docs(text) with topic, the one most of whose words occur (the first of TOPICS on ties),
    and n_tokens, the words and one end. Each text is split once."""
    split = docs.select(*columns, F.split(F.translate(F.coalesce("text", F.lit("")), _UPPER, _UPPER.lower()), r"[\x20\x09-\x0D]+").alias("_words"))
    topics = _topic_words()
    known = sorted({w for words in topics.values() for w in words})
    hits = F.filter(F.transform("_words", lambda w: F.rtrim(w, F.lit(_MARKS))), lambda w: w.isin(known))
    rows = split.select(*columns, hits.alias("_hits"), (F.size(F.filter("_words", lambda w: w != "")) + 1).cast("long").alias("n_tokens"))

    def count(words: list[str]) -> Column:
        return F.size(F.filter("_hits", lambda w: w.isin(words)))

    best = F.greatest(*(F.struct(count(words).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, words) in enumerate(topics.items())))
    return rows.select(*columns, F.when(F.size("_hits") == 0, OTHER).otherwise(best["name"]).alias("topic"), "n_tokens")


def wanted(values: dict[str, float], target: dict[str, float] | float, budget: float) -> dict[str, float]:
    """The tokens to sample of each value, given its tokens: `budget` of them all, no value beyond its own."""
    goal = budget * sum(values.values())
    if isinstance(target, dict):
        free = sum(v for k, v in values.items() if k not in target or k == REST)
        rest = target.get(REST, max(0.0, 1 - sum(v for k, v in target.items() if k != REST)))
        raw = {k: target[k] if k in target and k != REST else rest * v / free for k, v in values.items()}
    else:
        raw = {k: (v / sum(values.values())) ** target for k, v in values.items()}
    return dict(zip(raw, _reachable(np.array(list(raw.values())), np.array([values[k] for k in raw]), goal).tolist(), strict=True))


def _reachable(raw: np.ndarray, have: np.ndarray, goal: float) -> np.ndarray:
    """min(have, x * raw) for the x at which they sum to the goal, or as near to it as they come."""
    some = np.flatnonzero(raw > 0)
    out = np.zeros(len(raw))
    if not len(some):
        return out
    order = some[np.argsort(have[some] / raw[some], kind="stable")]
    full = np.concatenate([[0], np.cumsum(have[order])[:-1]])
    left = np.cumsum(raw[order][::-1])[::-1]
    x = (goal - full) / left
    ok = np.flatnonzero(x * raw[order] <= have[order])
    out[order] = np.minimum(have[order], (x[ok[0]] if len(ok) else np.inf) * raw[order])
    return out


def rake(labels: list[np.ndarray], tokens: np.ndarray, wants: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Weights of cells; labels: for each dimension the number of the cell's value; wants: its tokens to sample."""
    w = np.ones(len(tokens))
    for _ in range(rounds):
        moved = 0.0
        for own, want in zip(labels, wants, strict=True):
            have = np.bincount(own, tokens * np.minimum(w, 1.0), len(want))
            factor = np.where(have > 0, want / np.where(have > 0, have, 1), 0.0)
            moved = max(moved, float(np.abs(factor[have > 0] - 1).max(initial=0.0)))
            w = w * factor[own]
        if moved < STEADY:
            break
    return w


def _local(rows: list, targets: dict, budget: float, rounds: int) -> list[tuple]:
    rows = sorted(rows, key=lambda r: tuple(r[d] for d in DIMS))
    tokens = np.array([r["tokens"] for r in rows], float)
    labels, wants = [], []
    for d in DIMS:
        names, own = np.unique(np.array([r[d] for r in rows], object), return_inverse=True)
        want = wanted(dict(zip(names.tolist(), np.bincount(own, tokens).tolist(), strict=True)), targets[d], budget)
        labels.append(own)
        wants.append(np.array([want[n] for n in names]))
    return [(*(r[d] for d in DIMS), float(w)) for r, w in zip(rows, rake(labels, tokens, wants, rounds), strict=True)]


def _small(df: DataFrame, *labels: str) -> bool:
    """Whether df is proven to be small enough to broadcast."""
    n, longest = df.agg(F.count("*"), F.max(sum((F.octet_length(c) for c in labels), F.lit(0)))).first()
    return n <= MOST_BROADCAST and (longest or 0) <= LABEL_BYTES


def _distributed(cells: DataFrame, targets: dict, budget: float, rounds: int) -> DataFrame:
    """The same over a table of cells of any length. Sums by value are pre-aggregated, so a value with
    a third of the cells is no burden."""
    wants, small = {}, {}
    for d in DIMS:
        sums = materialise(cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("have")), "marginals")
        goal = budget * (sums.agg(F.sum("have")).first()[0] or 0.0)
        total = goal / budget if budget else 1.0
        if isinstance(targets[d], dict):
            own = {k: float(v) for k, v in targets[d].items() if k != REST}
            given = F.coalesce(*[F.when(F.col(d) == k, F.lit(v)) for k, v in own.items()], F.lit(None).cast("double"))
            free = sums.select(F.sum(F.when(given.isNull(), F.col("have")))).first()[0] or 1.0
            rest = targets[d].get(REST, max(0.0, 1 - sum(own.values())))
            raw = F.coalesce(given, F.lit(float(rest)) * F.col("have") / F.lit(free))
        else:
            raw = F.pow(F.col("have") / F.lit(total), F.lit(float(targets[d])))
        sums = materialise(sums.withColumn("raw", raw), "marginals")
        # Values that can't reach their share give all they have; of what the goal is then, the others take their part.
        x = 0.0
        for _ in range(200):
            full = F.lit(x) * F.col("raw") >= F.col("have")
            taken, left = sums.where("raw > 0").agg(F.sum(F.when(full, F.col("have")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("raw")))).first()
            nearer = (goal - taken) / left if left else x
            if not left or nearer <= x:
                x = x if left or taken is None else float("inf")
                break
            x = nearer
        scaled = F.when(F.col("raw") > 0, F.least(F.col("have"), F.col("have") if x == float("inf") else F.lit(x) * F.col("raw"))).otherwise(0.0)
        wants[d] = materialise(sums.select(d, scaled.alias("want")), "wants")
        small[d] = _small(wants[d], d)
    out = cells.withColumn("weight", F.lit(1.0))
    for _ in range(rounds):
        moved = 0.0
        for d in DIMS:
            have = out.groupBy(d).agg(F.sum(F.col("tokens") * F.least("weight", F.lit(1.0))).alias("now"))
            factors = materialise(have.join(wants[d], d).select(d, F.when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(0.0).alias("factor"), "now"), "factors")
            moved = max(moved, factors.where("now > 0").agg(F.max(F.abs(F.col("factor") - 1))).first()[0] or 0.0)
            factors = factors.select(d, "factor")
            out = out.join(F.broadcast(factors) if small[d] else factors, d).select(*DIMS, "tokens", (F.col("weight") * F.col("factor")).alias("weight"))
        out = materialise(out, "raked")
        if moved < STEADY:
            break
    return out.select(*DIMS, "weight")


def _keys() -> list[Column]:
    return [F.coalesce(F.col(d).cast("string"), F.lit("")).alias(f"cell_{d}") for d in DIMS]


def mix(docs: DataFrame, targets: dict | None = None, budget: float = BUDGET, rounds: int = ROUNDS, most_cells: int = MOST_CELLS) -> DataFrame:
    """docs(doc_id, text, source, lang, ...) with topic, n_tokens, weight, p and sampled."""
    targets = TARGETS | (targets or {})
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("topic", "n_tokens", "weight", "p", "sampled")]
    counted = described(docs, "source", "lang").select(*_keys(), "n_tokens")
    cells = materialise(counted.groupBy(*(f"cell_{d}" for d in DIMS)).agg(F.sum("n_tokens").alias("tokens")).toDF(*DIMS, "tokens"), "cells")
    n = cells.count()
    schema = "source string, lang string, topic string, weight double"
    if n == 0:
        weights = spark.createDataFrame([], schema)
    elif n <= most_cells:
        weights = spark.createDataFrame(_local(cells.collect(), targets, budget, rounds), schema)
    else:
        weights = _distributed(cells, targets, budget, rounds)
    few = _small(cells, *DIMS)
    weights = weights.toDF(*(f"cell_{d}" for d in DIMS), "weight")
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("mix/"), key).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    rows = described(docs, *own).select("*", *_keys()).join(F.broadcast(weights) if few else weights, [f"cell_{d}" for d in DIMS], "left")
    p = F.least(F.col("weight"), F.lit(1.0))
    return rows.select(*own, "topic", "n_tokens", "weight", p.alias("p"), (draw < p).alias("sampled"))


def report(mixed: DataFrame, targets: dict | None = None) -> DataFrame:
    """(dimension, value, target, expected, sampled) of the rows that `mix` gave: shares of the tokens aimed
    at (before what a value can't reach is shared out), expected by the probabilities, and sampled."""
    targets = TARGETS | (targets or {})
    tokens = F.col("n_tokens")
    out = []
    for d in DIMS:
        value = F.coalesce(F.col(d).cast("string"), F.lit("")).alias("value")
        sums = mixed.groupBy(value).agg(F.sum(tokens).cast("double").alias("have"), F.sum(tokens * F.col("p")).alias("e"), F.sum(tokens * F.col("sampled").cast("long")).alias("s"))
        if isinstance(targets[d], dict):
            own = {k: float(v) for k, v in targets[d].items() if k != REST}
            rest = targets[d].get(REST, max(0.0, 1 - sum(own.values())))
            given = F.coalesce(*[F.when(F.col("value") == k, F.lit(v)) for k, v in own.items()], F.lit(None).cast("double"))
            sums = sums.withColumn("free", F.when(given.isNull(), F.col("have"))).crossJoin(F.broadcast(mixed.agg(F.sum(F.when(~value.isin(list(own)), tokens)).alias("all_free")))) if own else sums
            sums = sums.withColumn("raw", F.coalesce(given, F.lit(float(rest)) * F.col("free") / F.col("all_free")))
        else:
            sums = sums.withColumn("raw", F.pow("have", F.lit(float(targets[d]))))
        whole = sums.agg(F.sum("raw").alias("raw_all"), F.sum("e").alias("e_all"), F.sum("s").alias("s_all"))
        share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
        out.append(sums.join(F.broadcast(whole)).select(F.lit(d).alias("dimension"), "value", share("raw", "raw_all").alias("target"), share("e", "e_all").alias("expected"), share("s", "s_all").alias("sampled")))
    return reduce(DataFrame.unionByName, out)


def mix_sql(table: str = "documents", targets: dict | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for doc_id, source, lang, topic, n_tokens, weight, p and sampled."""
    targets = TARGETS | (targets or {})
    topics = _topic_words()
    quote = lambda words: ", ".join(f"'{w}'" for w in words)
    known = sorted({w for words in topics.values() for w in words})
    # The best topic by count, the first on ties: the greatest of count * 100 - place.
    scores = ", ".join(f"len(list_filter(hits, lambda w: w IN ({quote(words)}))) * 100 - {k}" for k, words in enumerate(topics.values()))
    ctes = [
        f"t AS (SELECT doc_id, text, source, lang, string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x20\\x09-\\x0D]+') AS words FROM {table})",
        f"h AS (SELECT doc_id, text, source, lang, CAST(len(list_filter(words, lambda w: w <> '')) AS BIGINT) + 1 AS n_tokens, list_filter(list_transform(words, lambda w: rtrim(w, '{_MARKS}')), lambda w: w IN ({quote(known)})) AS hits FROM t)",
        f"d AS (SELECT doc_id, text, source, lang, n_tokens, CASE WHEN len(hits) = 0 THEN '{OTHER}' ELSE [{quote(topics)}][list_position([{scores}], list_max([{scores}]))] END AS topic FROM h)",
        "c AS MATERIALIZED (SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)",
    ]
    for x in DIMS:
        if isinstance(targets[x], dict):
            own = {k: v for k, v in targets[x].items() if k != REST}
            rest = targets[x].get(REST, max(0.0, 1 - sum(own.values())))
            given = "CASE " + " ".join(f"WHEN {x} = '{k}' THEN {v}" for k, v in own.items()) + " ELSE NULL END"
            ctes.append(f"g_{x} AS (SELECT {x}, sum(tokens) AS have, {given} AS given FROM c GROUP BY {x})")
            ctes.append(f"r_{x} AS (SELECT {x}, have, coalesce(given, {rest} * have / sum(CASE WHEN given IS NULL THEN have END) OVER ()) AS raw FROM g_{x})")
        else:
            ctes.append(f"r_{x} AS (SELECT {x}, sum(tokens) AS have, pow(sum(tokens) / (SELECT sum(tokens) FROM c), {targets[x]}) AS raw FROM c GROUP BY {x})")
        order = f"ORDER BY have / raw, {x}"
        ctes.append(f"o_{x} AS (SELECT *, {budget} * (SELECT sum(tokens) FROM c) - coalesce(sum(have) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS goal, sum(raw) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others FROM r_{x} WHERE raw > 0)")
        ctes.append(f"x_{x} AS (SELECT min_by(goal / others, have / raw) AS x FROM o_{x} WHERE goal / others * raw <= have)")
        ctes.append(f"s_{x} AS (SELECT {x}, CASE WHEN raw > 0 THEN least(have, coalesce((SELECT x FROM x_{x}), 1e300) * raw) ELSE 0 END AS want_{x} FROM r_{x})")
    inner = "r"
    for x in DIMS:
        now = f"sum(tokens * least(w, 1)) OVER (PARTITION BY {x})"
        inner = f"(SELECT * REPLACE (CASE WHEN {now} > 0 THEN w * want_{x} / {now} ELSE 0 END AS w) FROM {inner}{' WHERE k < ' + str(rounds) if inner == 'r' else ''})"
    ctes.append("r AS (SELECT c.*, CAST(1 AS DOUBLE) AS w, 0 AS k, " + ", ".join(f"want_{x}" for x in DIMS) + " FROM c " + " ".join(f"JOIN s_{x} USING ({x})" for x in DIMS) + f" UNION ALL SELECT * REPLACE (k + 1 AS k) FROM {inner})")
    ctes.append(f"p AS (SELECT source, lang, topic, w AS weight, least(1, w) AS p FROM r WHERE k = {rounds})")
    draw = "('0x' || substr(md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 12))::BIGINT / 281474976710656.0"
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(weight, 6) AS weight, round(p, 6) AS p, {draw} < p AS sampled FROM d JOIN p ON coalesce(d.source, '') = p.source AND coalesce(d.lang, '') = p.lang AND d.topic = p.topic"
