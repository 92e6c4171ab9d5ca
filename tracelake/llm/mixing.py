"""Mixing sources to target weights by iterative proportional fitting.

Documents are combined to cells of (source, language, topic) with their token
sums.  In turn, the weights of the cells are scaled so that each source, then
each language, then each topic gets its target share, until every share is within
``TOLERANCE`` of its target after ``STEP``, twice ``STEP`` ... rounds (``ROUNDS`` at
most; marginals that are then still off are warned of).  A document's weight is its cell's
scaling factor; it is sampled with a probability proportional to that factor,
the greatest factor setting the largest share that needs no capping (``budget``
at most), so that the expected token shares of the sample are the raked ones.

A target share is given, or is the present share to a power (tempering where it
is less than one), among the values that occur.  Values that given targets do not
name keep their present share, and the named ones share the rest.

Topics, where no column is given for them, are groups of words fitted by language
on all documents (the SQL still counts the ``TOPIC_SAMPLE`` least by a hash of their
id, so the two agree up to so many): in each of the ``LANGUAGES`` commonest languages the seeds are the ``TOPICS`` words that most of
its documents hold, but not over half, and a seed has the ``COMPANIONS`` words
that it stands with most, by the cosine of their occurrences.  A document, read
as a whole, is of the topic of its language of whose words it holds the most,
the first of equals; of none, ``other``.  Groups of one rank share a marginal:
``topic-1`` is the widest group of every language.

Everything is a DataFrame operation.  Only cells are raked, texts never move
(but for the sample's): token sums are combined before the shuffle, and the
finished factors go to the documents by broadcast while there are at most
``BROADCAST_CELLS`` of them, else by a join.

Defined results: a null source or language is the value ``unknown``; null text
has no tokens and no topic; a document of a cell without tokens has weight 1;
rows that repeat (same id) are selected together; an empty table gives no rows;
all other columns are kept, but for the five that are added, which are replaced.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import fresh, materialize

log = logging.getLogger("tracelake")

DIMENSIONS = ("source", "lang", "topic")
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
ROUNDS = 50
STEP = 10
TOLERANCE = 1e-4
BUDGET = 0.5
SEED = "mix-1"
TOPICS = 4
COMPANIONS = 4
LANGUAGES = 16
TOPIC_SAMPLE = 2000
OTHER = "other"
BROADCAST_CELLS = 50_000
ADDED = ("mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_selected")
_WORD = r"[^\x20\x09-\x0D]+"
_CONTENT = r"^\p{L}{6,24}$"
#: In Java a dollar sign also matches before a line separator.
_CONTENT_WHOLE = r"^\p{L}{6,24}\z"
_BYTES = (6, 96)
#: Companions are first looked for in one document of so many.
SHARE = 256


def _digest(prefix: str) -> Column:
    return F.md5(F.concat(F.lit(prefix + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _once(docs: DataFrame) -> DataFrame:
    """(lang, text) of every document with a text; of rows that repeat an id the
    least, and no other texts than theirs move."""
    own = docs.select(_digest("topic").alias("mark"), F.coalesce("lang", F.lit("unknown")).alias("lang"), "text")
    # Counted without the texts, which need not be read for it.
    repeated = materialize(own.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark"))
    own = own.where("text is not null")
    n = repeated.count()
    if not n:
        return own.select("lang", "text")
    marks = F.broadcast(repeated) if n <= BROADCAST_CELLS else repeated
    least = own.join(marks, "mark", "left_semi").groupBy("mark").agg(F.min(F.struct("text", "lang")).alias("one"))
    return own.join(marks, "mark", "left_anti").select("lang", "text").unionByName(least.select("one.lang", "one.text"))


def _spaced(text: Column) -> Column:
    """``text`` with spaces for its other white space, byte for byte."""
    out, rare = text, [F.lit(c) for c in "\t\v\f\r"]
    for c in rare:
        out = F.replace(out, c, F.lit(" "))
    has = [F.contains(text, c) for c in rare]
    return F.replace(F.when(has[0] | has[1] | has[2] | has[3], out).otherwise(text), F.lit("\n"), F.lit(" "))


def _by_language(values: dict[str, int]) -> Column:
    chosen = F.lit(None).cast("long")
    for lang, value in values.items():
        chosen = F.when(F.col("lang") == lang, F.lit(value)).otherwise(chosen)
    return chosen


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_CELLS else df


def fit_topics(docs: DataFrame, topics: int = TOPICS, companions: int = COMPANIONS) -> dict[str, list[list[str]]]:
    """By language the words of each topic, its seed first.

    Texts are split once.  Companions are looked for among the words that a share
    of the language's documents hold.  As a word in n documents scores n / seed_n
    at most, the companions found tell how many documents another would need;
    where the share was more than that, it is lowered to it and the search repeated.
    """
    words = F.filter(F.split(_spaced(F.col("text")), " "), lambda w: F.octet_length(w).between(*_BYTES))
    # The empty word stands for the document.
    read = materialize(_once(docs).select("lang", F.array_distinct(F.concat(F.array(F.lit("")), words)).alias("words")))
    content = (F.col("word") == "") | F.rlike("word", F.lit(_CONTENT_WHOLE))
    counts = materialize(read.select("lang", F.explode("words").alias("word")).where(content).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    sizes = materialize(counts.where("word = ''").select("lang", F.col("n").alias("size")).orderBy(F.col("size").desc(), "lang").limit(LANGUAGES))
    held = counts.where("word <> ''").join(F.broadcast(sizes), "lang").where(F.col("n") * 2 <= F.col("size")).select("lang", "word", "n")
    widest = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    seeds = materialize(held.withColumn("topic", F.row_number().over(widest)).where(F.col("topic") <= topics).select("lang", "topic", F.col("word").alias("seed"), F.col("n").alias("seed_n")))
    others = held.join(F.broadcast(seeds.select("lang", F.col("seed").alias("word"))), ["lang", "word"], "left_anti")
    least = {r.lang: r.size // SHARE for r in sizes.collect()}
    while True:
        out, need = _companions(read, seeds, others.where(F.col("n") >= _by_language(least)), companions)
        if all(need.get(lang, n) >= n for lang, n in least.items()):
            return out
        least = {lang: min(n, need.get(lang, n)) for lang, n in least.items()}


def _companions(read: DataFrame, seeds: DataFrame, others: DataFrame, companions: int) -> tuple[dict[str, list[list[str]]], dict[str, int]]:
    """The topics with companions among ``others``, and by language in how many
    documents another word must be to change them."""
    others = materialize(others)
    # A bit for each seed that a document holds; documents of the same bits are
    # counted together by word, so no word is paired with another.
    bits, first = F.lit(0).cast("long"), seeds.collect()
    for r in first:
        bits = bits + F.when((F.col("lang") == r.lang) & F.array_contains("words", r.seed), 1 << (r.topic - 1)).otherwise(0)
    # Exploded, for a filter on a plain column would compute it twice.
    marked = read.select("lang", "words", F.explode(F.array(bits)).alias("bits")).where("bits <> 0")
    beside = marked.select("lang", "bits", F.explode("words").alias("word")).join(_small(others.select("lang", "word")), ["lang", "word"], "left_semi")
    beside = beside.groupBy("lang", "bits", "word").agg(F.count(F.lit(1)).alias("m"))
    pairs = beside.join(F.broadcast(seeds), "lang").where(F.expr("shiftright(bits, topic - 1) % 2 = 1")).groupBy("lang", "topic", "seed_n", "word").agg(F.sum("m").alias("both")).where("both >= 2")
    scored = pairs.join(others, ["lang", "word"]).withColumn("score", F.col("both") * F.col("both") / (F.col("n") * F.col("seed_n")).cast("double"))
    closest = Window.partitionBy("lang", "topic").orderBy(F.col("score").desc(), "word")
    near = scored.withColumn("rank", F.row_number().over(closest)).where(F.col("rank") <= companions).select("lang", "topic", "rank", "word", "score").collect()
    out, need = {}, {}
    for lang in sorted({r.lang for r in first}):
        own = sorted((r for r in first if r.lang == lang), key=lambda r: r.topic)
        beside_seed = [sorted((c for c in near if (c.lang, c.topic) == (lang, r.topic)), key=lambda c: c.rank) for r in own]
        out[lang] = [[r.seed, *(c.word for c in found)] for r, found in zip(own, beside_seed)]
        # Rounded down, as the score is a rounded quotient.
        need[lang] = min(int(found[-1].score * r.seed_n * (1 - 1e-9)) if len(found) == companions else 0 for r, found in zip(own, beside_seed))
    return out, need


def topic_of(text: Column, lang: Column, topics: dict[str, list[list[str]]]) -> Column:
    """``topic-n`` of the n-th group of the language's words."""
    text, lang = F.coalesce(text, F.lit("")), F.coalesce(lang, F.lit("unknown"))
    named = F.lit(OTHER)
    for own, groups in topics.items():
        counts = [sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)) for words in groups]
        # The count in the high digits, the place from the end in the low ones.
        n = len(groups)
        best = F.greatest(*(c * n + (n - 1 - i) for i, c in enumerate(counts)), F.lit(0))
        # Looked up, so that the texts are searched once.
        names = [OTHER if b < n else f"topic-{n - b % n}" for b in range(n * (max(map(len, groups)) + 1))]
        named = F.when(lang == own, F.element_at(F.array(*map(F.lit, names)), best + 1)).otherwise(named)
    return named


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``, the raked share
    over the present share."""
    total = F.sum("tokens").cast("double")
    cells = materialize(cells.where("tokens > 0").withColumn("share", F.col("tokens").cast("double")))
    all_tokens = cells.agg(total.alias("all_tokens"))
    shares = {}
    for d in DIMENSIONS:
        if targets and d in targets:
            rows = [(k, float(v)) for k, v in targets[d].items()]
            given = cells.sparkSession.createDataFrame(rows, f"{d} string, given double")
            present = cells.groupBy(d).agg(total.alias("present")).crossJoin(F.broadcast(all_tokens)).withColumn("present", F.col("present") / F.col("all_tokens"))
            both = present.join(F.broadcast(given), d, "left")
            sums = both.agg(F.sum("given").alias("named"), F.sum(F.when(F.col("given").isNull(), F.col("present"))).alias("unnamed"))
            share = F.coalesce(F.try_divide(F.col("given") * (1 - F.coalesce("unnamed", F.lit(0.0))), F.col("named")), F.col("present"))
            own = both.crossJoin(F.broadcast(sums)).select(d, share.alias("raw"))
        else:
            own = cells.groupBy(d).agg(F.pow(total, POWERS[d]).alias("raw"))
        whole = own.agg(F.sum("raw").alias("whole"))
        shares[d] = materialize(own.crossJoin(F.broadcast(whole)).select(d, F.try_divide("raw", "whole").alias("target")))
    raked = cells.crossJoin(F.broadcast(all_tokens)).withColumn("w", F.col("share") / F.col("all_tokens")).withColumn("share", F.col("w"))
    for d in DIMENSIONS:
        raked = raked.join(shares[d].withColumnRenamed("target", f"target_{d}"), d, "left")
    # Only aggregated cells are windowed, a few columns of numbers each; no cell
    # is gathered to one row, and no round reads the one before it twice.
    for begun in range(0, rounds, STEP):
        for _ in range(begun, min(begun + STEP, rounds)):
            for d in DIMENSIONS:
                now = F.sum("w").over(Window.partitionBy(d))
                raked = raked.withColumn("w", F.coalesce(F.try_divide(F.col("w") * F.col(f"target_{d}"), now), F.lit(0.0)))
        raked = materialize(raked)
        # The last dimension was scaled last, so the first two tell.
        sums = raked.select(F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.col(d).alias("v"), F.col(f"target_{d}").alias("target")) for d in DIMENSIONS))).alias("m"), "w")
        off = sums.groupBy("m").agg(F.abs(F.sum("w") - F.col("m.target")).alias("off")).agg(F.max("off")).first()[0] or 0.0
        if off <= tolerance:
            break
    else:
        log.warning("raking ended after %d rounds with a share off by %.1e", rounds, off)
    return raked.select(*DIMENSIONS, "tokens", F.try_divide("w", "share").alias("weight"))


def measured(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``docs`` with mix_topic and mix_tokens, from the whole texts."""
    docs = docs.drop(*ADDED)
    named = topic_of(F.col("text"), F.col("lang"), fit_topics(docs)) if topic is None else F.coalesce(topic, F.lit("unknown"))
    (own,) = fresh("mix_spaced", 1, docs.columns)
    spaced, space = F.col(own), F.lit(" ")
    # Where single spaces part the words, their bytes tell the number.
    ragged = (spaced == "") | F.startswith(spaced, space) | F.endswith(spaced, space) | F.contains(spaced, F.lit("  "))
    single = F.octet_length(spaced) - F.octet_length(F.replace(spaced, space, F.lit(""))) + 1
    tokens = F.when(ragged, F.regexp_count(spaced, F.lit(_WORD))).otherwise(single).cast("long")
    return docs.withColumn(own, _spaced(F.coalesce("text", F.lit("")))).withColumns({"mix_topic": named, "mix_tokens": tokens}).drop(own)


def sampled(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, budget: float = BUDGET) -> DataFrame:
    """What ``measured`` gives, with mix_weight, mix_probability, mix_selected."""
    own_source, own_lang = fresh("mix_key", 2, docs.columns)
    named = docs.withColumns({own_source: F.coalesce("source", F.lit("unknown")), own_lang: F.coalesce("lang", F.lit("unknown"))})
    keys = [F.col(own_source).alias("source"), F.col(own_lang).alias("lang"), F.col("mix_topic").alias("topic")]
    cells = named.groupBy(*keys).agg(F.sum("mix_tokens").alias("tokens"))
    raked = materialize(rake(cells, targets, rounds))
    n, most = raked.agg(F.count(F.lit(1)), F.max("weight")).first()
    keep = min(budget, 1 / most) if most else budget
    factors = raked.select(F.col("source").alias(own_source), F.col("lang").alias(own_lang), F.col("topic").alias("mix_topic"), F.col("weight").alias("mix_weight"))
    if n <= BROADCAST_CELLS:
        factors = F.broadcast(factors)
    u = F.conv(F.substring(_digest(SEED), 1, 13), 16, 10).cast("double") / 2.0**52
    weighed = named.join(factors, [own_source, own_lang, "mix_topic"], "left").withColumn("mix_weight", F.coalesce("mix_weight", F.lit(1.0)))
    weighed = weighed.withColumn("mix_probability", F.least(F.lit(1.0), F.col("mix_weight") * keep))
    return weighed.withColumn("mix_selected", u < F.col("mix_probability")).select(*docs.columns, "mix_weight", "mix_probability", "mix_selected")


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, budget: float = BUDGET, topic: Column | None = None) -> DataFrame:
    """``docs`` (doc_id, text, lang, source) and mix_topic, mix_tokens,
    mix_weight, mix_probability, mix_selected."""
    return sampled(measured(docs, topic), targets, rounds, budget)


def oracle_sql(rounds: int = ROUNDS, budget: float = BUDGET) -> str:
    """The same over the table documents, for DuckDB."""
    source, lang, topic = (POWERS[d] for d in DIMENSIONS)
    return f"""
WITH RECURSIVE marks AS (SELECT md5('topic:' || coalesce(doc_id::VARCHAR, '')) AS mark, coalesce(lang, 'unknown') AS lang, text FROM documents WHERE text IS NOT NULL),
texts AS (SELECT mark, min((text, lang)) AS one FROM marks WHERE mark IN (SELECT DISTINCT mark FROM marks ORDER BY mark LIMIT {TOPIC_SAMPLE}) GROUP BY mark),
sizes AS (SELECT one[2] AS lang, count(*) AS size FROM texts GROUP BY ALL ORDER BY size DESC, lang LIMIT {LANGUAGES}),
words AS (SELECT DISTINCT mark, lang, size, word FROM (SELECT mark, one[2] AS lang, unnest(regexp_split_to_array(one[1], '[\\x20\\x09-\\x0D]+')) AS word FROM texts) JOIN sizes USING (lang) WHERE regexp_matches(word, '{_CONTENT}')),
held AS (SELECT lang, word, count(*) AS n FROM words GROUP BY lang, size, word HAVING count(*) * 2 <= size),
seeds AS (SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS topic, word, n FROM held) WHERE topic <= {TOPICS}),
pairs AS (SELECT s.lang, s.topic, s.n AS seed_n, w.word, count(*) AS shared FROM seeds s JOIN words m ON m.word = s.word AND m.lang = s.lang JOIN words w ON w.mark = m.mark
  WHERE NOT EXISTS (SELECT 1 FROM seeds x WHERE x.lang = w.lang AND x.word = w.word) GROUP BY ALL HAVING count(*) >= 2),
near AS (SELECT lang, topic, word, row_number() OVER (PARTITION BY lang, topic ORDER BY shared * shared / (h.n * seed_n)::DOUBLE DESC, word) AS rank FROM pairs JOIN held h USING (lang, word)),
members AS (SELECT lang, topic, word FROM seeds UNION ALL SELECT lang, topic, word FROM near WHERE rank <= {COMPANIONS}),
numbered AS (SELECT row_number() OVER () AS row, doc_id, text, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang FROM documents),
hits AS (SELECT row, topic, count(*) AS n FROM numbered d JOIN members m ON m.lang = d.lang AND contains(coalesce(text, ''), word) GROUP BY ALL),
best AS (SELECT row, arg_min(topic, (-n, topic)) AS topic FROM hits GROUP BY row),
d AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens, coalesce('topic-' || topic, '{OTHER}') AS topic
  FROM numbered LEFT JOIN best USING (row)),
cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0),
ts AS (SELECT source, pow(sum(tokens), {source}) / sum(pow(sum(tokens), {source})) OVER () AS t FROM cells GROUP BY source),
tl AS (SELECT lang, pow(sum(tokens), {lang}) / sum(pow(sum(tokens), {lang})) OVER () AS t FROM cells GROUP BY lang),
tt AS (SELECT topic, pow(sum(tokens), {topic}) / sum(pow(sum(tokens), {topic})) OVER () AS t FROM cells GROUP BY topic),
start AS (
  SELECT 0 AS i, c.source, c.lang, c.topic, tokens / sum(tokens) OVER () AS share, tokens / sum(tokens) OVER () AS w,
    ts.t AS s, tl.t AS l, tt.t AS o
  FROM cells c JOIN ts USING (source) JOIN tl USING (lang) JOIN tt USING (topic)),
ipf AS (
  SELECT * FROM start
  UNION ALL
  SELECT i + 1, source, lang, topic, share, w2 * o / sum(w2) OVER (PARTITION BY topic), s, l, o FROM (
    SELECT *, w1 * l / sum(w1) OVER (PARTITION BY lang) AS w2 FROM (
      SELECT *, w * s / sum(w) OVER (PARTITION BY source) AS w1 FROM ipf WHERE i < {rounds}))),
off AS (
  SELECT i, max(off) AS off FROM (
    SELECT i, abs(sum(w) - any_value(s)) AS off FROM ipf GROUP BY i, source UNION ALL SELECT i, abs(sum(w) - any_value(l)) FROM ipf GROUP BY i, lang
    UNION ALL SELECT i, abs(sum(w) - any_value(o)) FROM ipf GROUP BY i, topic) GROUP BY i),
f AS (SELECT source, lang, topic, w / share AS weight FROM ipf WHERE i = (SELECT coalesce(min(i), {rounds}) FROM off WHERE i > 0 AND i % {STEP} = 0 AND off <= {TOLERANCE})),
k AS (SELECT least({budget}, 1 / max(weight)) AS keep FROM f),
p AS (
  SELECT d.doc_id, d.topic, d.tokens, coalesce(weight, 1.0) AS weight, least(1.0, coalesce(weight, 1.0) * keep) AS probability
  FROM d LEFT JOIN f USING (source, lang, topic) CROSS JOIN k)
SELECT doc_id, topic AS mix_topic, tokens AS mix_tokens, round(weight, 6) AS mix_weight, round(probability, 6) AS mix_probability,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 < probability AS mix_selected
FROM p"""
