"""Queries over texts: tokens, rhythm, tells, dashes, percentiles, intents, cleaning, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.functions import stats, text as T
from proseline.functions.python import mtld
from proseline.operators import cleaning, dedup, reports, resample
from proseline.plans import duck as D
from proseline.plans import views as V

R = 6
OUT = f"WITH o AS ({V.OUTPUTS_SQL})"
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, R).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"{OUT} SELECT doc_id, {D.n_tokens('text')} AS n_words FROM o")
def tok_word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return V.outputs(spark, sf).select("doc_id", T.n_tokens(F.col("text")).alias("n_words"))


@query(
    f"""{OUT}, c AS (SELECT model, scenario, {D.opener('text')} AS opener, count(*) AS n FROM o GROUP BY 1, 2, 3),
s AS (SELECT model, scenario, max(n) / sum(n) AS share FROM c GROUP BY 1, 2)
SELECT model, CAST(count(*) AS BIGINT) AS scenarios, round(avg(share), {R}) AS modal_share FROM s GROUP BY 1"""
)
def tok_opener_modal_share(spark: SparkSession, sf: str) -> DataFrame:
    counts = V.outputs(spark, sf).groupBy("model", "scenario", T.opener(F.col("text")).alias("opener")).agg(F.count("*").alias("n"))
    share = counts.groupBy("model", "scenario").agg((F.max("n") / F.sum("n")).alias("share"))
    return share.groupBy("model").agg(F.count("*").alias("scenarios"), F.round(F.avg("share"), R).alias("modal_share"))


@query(f"{OUT}, s AS (SELECT doc_id, {D.sentences('text')} AS l FROM o) SELECT doc_id, round({D.spread('l')}, {R}) AS burstiness FROM s")
def sent_burstiness(spark: SparkSession, sf: str) -> DataFrame:
    return V.outputs(spark, sf).select("doc_id", F.round(T.burstiness(F.col("text")), R).alias("burstiness"))


@query(f"{OUT}, s AS (SELECT doc_id, {D.paragraphs('text')} AS l FROM o) SELECT doc_id, round({D.spread('l')}, {R}) AS para_spread FROM s")
def para_variance(spark: SparkSession, sf: str) -> DataFrame:
    return V.outputs(spark, sf).select("doc_id", F.round(T.paragraph_spread(F.col("text")), R).alias("para_spread"))


_TELLS = ", ".join(f"{D.hits('text', t)} AS {t}" for t in T.TELLS)
_LONG = f"""h AS (SELECT doc_id, model, domain, {D.n_tokens('text')} AS n_words, {_TELLS} FROM o),
long AS (UNPIVOT h ON {', '.join(T.TELLS)} INTO NAME tell VALUE hits)"""


def _long(df: DataFrame) -> DataFrame:
    """One row for each text and tell, each pattern run once."""
    rows = df.select("doc_id", "model", "domain", T.n_tokens(F.col("text")).alias("n_words"), *[c.alias(k) for k, c in T.tell_hits(F.col("text")).items()])
    return rows.unpivot(["doc_id", "model", "domain", "n_words"], list(T.TELLS), "tell", "hits")


@query(f"{OUT}, {_LONG} SELECT doc_id, tell, hits FROM long WHERE hits > 0")
def tell_rates_long(spark: SparkSession, sf: str) -> DataFrame:
    return _long(V.outputs(spark, sf)).where("hits > 0").select("doc_id", "tell", "hits")


@query(
    f"""{OUT}, {_LONG} SELECT model, domain, tell, CAST(sum(hits) AS BIGINT) AS hits, round(1000.0 * sum(hits) / sum(n_words), {R}) AS pooled,
round(avg(1000.0 * hits / greatest(n_words, 1)), {R}) AS mean_rate FROM long GROUP BY 1, 2, 3"""
)
def tell_rates_pooled(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(
        _long(V.outputs(spark, sf)).groupBy("model", "domain", "tell").agg(
            F.sum("hits").alias("hits"), stats.pooled(F.col("hits"), F.col("n_words")).alias("pooled"),
            F.avg(1000 * F.col("hits") / F.greatest("n_words", F.lit(1))).alias("mean_rate"),
        )
    )


@query(f"{OUT}, {_LONG} SELECT domain, tell, round(avg(CAST(hits > 0 AS INT)), {R}) AS share FROM long GROUP BY 1, 2")
def tell_doc_share(spark: SparkSession, sf: str) -> DataFrame:
    return _long(V.outputs(spark, sf)).groupBy("domain", "tell").agg(F.round(F.avg((F.col("hits") > 0).cast("double")), R).alias("share"))


_DASH = ", ".join(f"{D.hits('text', t, T.DASHES)} AS {t}" for t in T.DASHES)


@query(
    f"""{OUT}, h AS (SELECT domain, {D.n_tokens('text')} AS n_words, {_DASH} FROM o),
long AS (UNPIVOT h ON {', '.join(T.DASHES)} INTO NAME form VALUE hits)
SELECT domain, form, CAST(sum(hits) AS BIGINT) AS hits, round(1000.0 * sum(hits) / sum(n_words), {R}) AS pooled FROM long GROUP BY 1, 2"""
)
def dash_forms(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reports.corpus_profile(V.outputs(spark, sf).select("domain", "text"), ["domain"])["dashes"])


def _points(column: str) -> str:
    return ", ".join(f"{D.nearest(column, p)} AS p{int(p * 100)}" for p in stats.POINTS)


@query(
    f"""WITH h AS ({V.HUMAN_SQL}), n AS (SELECT domain, {D.n_tokens('text')} AS n_words FROM h)
SELECT domain, count(*) AS n, {_points('n_words')} FROM n GROUP BY 1"""
)
def corpus_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.human(spark, sf).select("domain", T.n_tokens(F.col("text")).cast("double").alias("n_words"))
    return stats.percentiles(rows, "n_words", ["domain"])


def _summary_sql(lengths: str) -> str:
    return f"""WITH h AS ({V.HUMAN_SQL}), l AS (SELECT domain, {lengths} AS l FROM h), s AS (SELECT domain, {D.spread('l')} AS v FROM l)
SELECT domain, count(v) AS n, round(avg(v), {R}) AS mean, round({D.nearest('v', 0.5)}, {R}) AS median,
round({D.nearest('v', 0.25)}, {R}) AS q1, round({D.nearest('v', 0.75)}, {R}) AS q3 FROM s WHERE v IS NOT NULL GROUP BY 1"""


@query(_summary_sql(D.sentences("text")))
def corpus_rhythm(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.summary(V.human(spark, sf).select("domain", T.burstiness(F.col("text")).alias("v")), "v", ["domain"]))


@query(_summary_sql(D.paragraphs("text")))
def corpus_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.summary(V.human(spark, sf).select("domain", T.paragraph_spread(F.col("text")).alias("v")), "v", ["domain"]))


@query(
    f"""{OUT}, b AS (SELECT {D.intent('text')} AS intent, {D.n_tokens('text')} AS n_words FROM o WHERE domain = 'email')
SELECT intent, count(*) AS n, {_points('n_words')} FROM b GROUP BY 1"""
)
def intent_buckets(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.outputs(spark, sf).where("domain = 'email'").select(T.intent(F.col("text")).alias("intent"), T.n_tokens(F.col("text")).cast("double").alias("n_words"))
    return stats.percentiles(rows, "n_words", ["intent"])


@query(
    f"""WITH t AS (SELECT source, list_transform({D.tokens('text')}, lambda w: lower(w)) AS w FROM documents), m AS (SELECT source, {D.mtld('w')} AS v FROM t)
SELECT source, count(v) AS n, round(avg(v), {R}) AS mtld FROM m GROUP BY 1"""
)
def mtld_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical diversity is a loop over tokens: an Arrow function."""
    rows = V.table(spark, sf, "documents").select("source", mtld("text").alias("mtld"))
    return rows.groupBy("source").agg(F.count("mtld").alias("n"), F.round(F.avg("mtld"), R).alias("mtld"))


_WORDS = f"list_transform({D.tokens('text')}, lambda w: lower(w))"
_STOP = "[" + ", ".join(map(D.quoted, sorted(set(cleaning.STOPWORDS)))) + "]"
_ENGLISH = f"""t AS (SELECT doc_id, text, {_WORDS} AS w, array_to_string({D.tokens('text')}, ' ') AS j FROM documents),
e AS (SELECT doc_id, text, len(w) AS n,
  CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains({_STOP}, x))) / len(w) ELSE 0.0 END AS stop,
  CASE WHEN len(regexp_extract_all(j, '\\p{{L}}')) > 0
    THEN len(regexp_extract_all(j, '[A-Za-z]')) / len(regexp_extract_all(j, '\\p{{L}}')) ELSE 0.0 END AS ascii FROM t)"""


@query(
    f"""WITH {_ENGLISH} SELECT doc_id, n >= 30 AND stop >= 0.08 AND ascii >= 0.97 AS strict,
n >= 3 AND ascii >= 0.90 AND (n <= 6 OR stop >= 0.03) AS chat FROM e"""
)
def english_filter(spark: SparkSession, sf: str) -> DataFrame:
    signs = V.table(spark, sf, "documents").select("doc_id", cleaning.language_signs(F.col("text")).alias("s"))
    return signs.select("doc_id", cleaning.english(F.col("s"), 30).alias("strict"), cleaning.english(F.col("s"), 3, strict=False).alias("chat"))


_CAPS = "regexp_matches({0}, '\\p{{Lu}}') AND NOT regexp_matches({0}, '[\\p{{Ll}}\\p{{Lt}}]')"
_LINES = "list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))"
_ORDERLY = f"""len(l) > 0 AND len(list_filter(l, lambda x: len(regexp_extract_all(x, '\\p{{Nd}}')) >= 6)) <= 0.5 * len(l)
AND len(list_filter(l, lambda x: length({D.stripped('x')}) >= 15 AND {_CAPS.format(D.stripped('x'))})) <= 0.3 * len(l)"""


@query(
    f"""{OUT}, l AS (SELECT doc_id, text, {_LINES} AS l FROM o)
SELECT doc_id, {_ORDERLY} AS orderly, regexp_matches(text, {D.quoted('(?i)' + cleaning.PRONOUN)}) AND {_ORDERLY} AS business FROM l"""
)
def register_filter(spark: SparkSession, sf: str) -> DataFrame:
    return V.outputs(spark, sf).select("doc_id", cleaning.is_orderly(F.col("text")).alias("orderly"), cleaning.is_business(F.col("text")).alias("business"))


_PROSE = f"""n > 0 AND (letters = 0 OR digits <= 0.15 * (digits + letters)) AND caps <= {{}} * long"""


@query(
    f"""WITH t AS (SELECT doc_id, text, {D.tokens('text')} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, len(regexp_extract_all(text, '\\p{{Nd}}')) AS digits, len(regexp_extract_all(text, '\\p{{L}}')) AS letters,
  len(list_filter(w, lambda x: length(x) >= 3)) AS long,
  len(list_filter(w, lambda x: length(x) >= 3 AND {_CAPS.format('x')})) AS caps FROM t)
SELECT doc_id, {_PROSE.format(0.3)} AS essay, {_PROSE.format(0.5)} AS post FROM p"""
)
def spam_ratio_filter(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").select(
        "doc_id", cleaning.is_prose(F.col("text")).alias("essay"), cleaning.is_prose(F.col("text"), 0.5).alias("post")
    )


@query(
    f"""WITH {_ENGLISH}, l AS (SELECT e.*, {_LINES} AS l FROM e),
f AS (SELECT CASE WHEN NOT n BETWEEN 30 AND 400 THEN 'word_count' WHEN NOT (stop >= 0.08 AND ascii >= 0.97) THEN 'english'
  WHEN NOT (regexp_matches(text, {D.quoted('(?i)' + cleaning.PRONOUN)}) AND {_ORDERLY}) THEN 'register' END AS failed FROM l),
s AS (SELECT * FROM (VALUES (1, 'word_count'), (2, 'english'), (3, 'register')) v(number, stage)),
d AS (SELECT number, stage, (SELECT count(*) FROM f WHERE failed = stage) AS dropped FROM s)
SELECT number, stage, dropped, CAST((SELECT count(*) FROM f) - sum(dropped) OVER (ORDER BY number) AS BIGINT) AS kept FROM d"""
)
def funnel_counts(spark: SparkSession, sf: str) -> DataFrame:
    tests = cleaning.stages("email", F.col("text"), F.col("text"))
    return cleaning.funnel(V.table(spark, sf, "documents").select(cleaning.first_failure(tests).alias("failed")), [n for n, _ in tests])


@query(
    f"""WITH h AS (SELECT doc_id, row_number() OVER (PARTITION BY sha1({D.normalised('text')}) ORDER BY doc_id) AS k FROM documents)
SELECT doc_id FROM h WHERE k = 1"""
)
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.exact(V.table(spark, sf, "documents").select("doc_id", "text"), position="doc_id").select("doc_id")


_FIRST = f"""x AS (SELECT doc_id, text, row_number() OVER (PARTITION BY sha1({D.normalised('text')}) ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL),
wd AS MATERIALIZED (SELECT doc_id, {D.tokens('lower(text)')} AS w FROM x WHERE k = 1), ws AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM wd),
us AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM ws),
u AS MATERIALIZED (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id) AS n FROM us)"""


@query(
    f"""WITH {_FIRST}, p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM u a JOIN u b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a, b, round(common / (na + nb - common), {R}) AS jaccard FROM p WHERE common / (na + nb - common) >= 0.8"""
)
def shingle_jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of documents of 0.8 or more by five-word shingles, copies first collapsed."""
    docs = dedup.exact(V.table(spark, sf, "documents").select("doc_id", "text"), position="doc_id")
    return _rounded(dedup.exact_similar(docs, position="doc_id"))


_MIN = ", ".join(f"min(CAST((CAST({a} AS HUGEINT) * (h % 2147483648) % {dedup.PRIME} + CAST({a} AS HUGEINT) * (h // 2147483648) % {dedup.PRIME} * 2147483648 + {b}) % {dedup.PRIME} AS BIGINT)) AS m{i}" for i, (a, b) in enumerate(dedup.coefficients()))


@query(
    f"""WITH RECURSIVE {_FIRST}, d AS (SELECT doc_id, n, s, md5(s) AS md FROM u),
hs AS (SELECT doc_id, n, s, (CAST(CAST('0x' || substr(md, 1, 16) AS UBIGINT) AS HUGEINT) * 8 + CAST('0x' || substr(md, 17, 16) AS UBIGINT)) % {dedup.PRIME} AS h FROM d),
g AS (SELECT doc_id, {_MIN} FROM hs GROUP BY 1),
c AS (SELECT doc_id, 0 AS band, [m0, m1, m2, m3] AS key FROM g UNION ALL SELECT doc_id, 1, [m4, m5, m6, m7] FROM g),
q AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM c a JOIN c b ON a.band = b.band AND a.key = b.key AND a.doc_id < b.doc_id),
j AS (SELECT q.a, q.b, count(*) AS common, any_value(x.n) AS na, any_value(y.n) AS nb FROM q JOIN u x ON x.doc_id = q.a JOIN u y ON y.doc_id = q.b AND x.s = y.s GROUP BY 1, 2),
l AS (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS k FROM j WHERE common / (na + nb - common) >= 0.8 GROUP BY b),
r AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone
  UNION ALL
  SELECT l.k, CASE WHEN len(list_filter(l.earlier, lambda e: NOT list_contains(r.gone, e))) > 0 THEN list_append(r.gone, l.b) ELSE r.gone END
  FROM r JOIN l ON l.k = r.k + 1),
z AS (SELECT gone FROM r ORDER BY k DESC LIMIT 1)
SELECT doc_id FROM x, z WHERE k = 1 AND NOT list_contains(z.gone, doc_id)"""
)
def minhash_near_dup(spark: SparkSession, sf: str) -> DataFrame:
    docs = dedup.exact(V.table(spark, sf, "documents").select("doc_id", "text"), position="doc_id")
    return dedup.near(docs, position="doc_id").select("doc_id")


@query(
    "WITH k AS (SELECT doc_id FROM documents ORDER BY md5(concat('20260114:', doc_id)), doc_id LIMIT 300) SELECT doc_id FROM k"
)
def capped_sample(spark: SparkSession, sf: str) -> DataFrame:
    return resample.sample_by_hash(V.table(spark, sf, "documents").select("doc_id"), 300, "doc_id")


@query("SELECT doc_id, 'doc-' || lpad(CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR), 6, '0') AS id FROM documents")
def seq_ids(spark: SparkSession, sf: str) -> DataFrame:
    return resample.numbered(V.table(spark, sf, "documents").select("doc_id"), "doc", "doc_id").select("doc_id", "id")


@query(
    f"""WITH u AS (SELECT doc_id, regexp_replace(concat('RT @a see https://x.example/', doc_id, ' ', text), '(?i)(https?://\\S+|www\\.\\S+)', ' ', 'g') AS t FROM documents)
SELECT doc_id, md5(trim(regexp_replace(t, '\\s{{2,}}', ' ', 'g'))) AS digest FROM u"""
)
def clean_tweets(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("RT @a see https://x.example/"), F.col("doc_id").cast("string"), F.lit(" "), F.col("text"))
    return V.table(spark, sf, "documents").select("doc_id", F.md5(cleaning.clean_post(raw)).alias("digest"))


@query(
    f"""WITH u AS (SELECT page_id, replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS t FROM pages),
c AS (SELECT page_id, {D.stripped("regexp_replace(regexp_replace(regexp_replace(t, '\\burlLink\\b', ' ', 'g'), '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM u)
SELECT page_id, md5(t) AS digest, length(t) AS n_chars FROM c"""
)
def clean_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Pages' HTML as post texts: character references and Windows-1252 code points repaired. The oracle knows the four
    references that the pages have; all others are tested against plain Python. A reference that a title's end cut before its
    semicolon isn't one, as in the oracle."""
    pages = V.table(spark, sf, "pages").select("page_id", cleaning.clean_essay(F.col("html"), closed=True).alias("t"))
    return pages.select("page_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars"))


@query(
    """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(concat('> ', replace(text, chr(10), ' `x` ')), '`[^`]*`', ' ', 'g'), '^>\\s?', ''), ' ')) AS digest
FROM (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM documents)"""
)
def clean_chats(spark: SparkSession, sf: str) -> DataFrame:
    docs = V.table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("text"))
    return docs.select("doc_id", F.md5(cleaning.clean_chat(F.concat(F.lit("> "), F.col("text")))).alias("digest"))


def _has(x: str, pattern: str, flags: str = "(?i)") -> str:
    return f"regexp_matches({x}, {D.quoted(flags + pattern)})"


_FIRST_LINE = D.stripped("ln[1]")
_LOST = "(?:" + "|".join(f"(?:{p})" for p in cleaning.LOST_LINES) + ")"


@query(
    f"""{OUT.replace("WITH", "WITH RECURSIVE")}, b0 AS (SELECT doc_id AS path, list_filter(string_split_regex(text, '\\n\\s*\\n+'), lambda x: regexp_matches(x, '\\S')) AS bl FROM o),
b1 AS (SELECT path, unnest(bl) AS block, unnest(range(1, len(bl) + 1)) AS k FROM b0),
b2 AS (SELECT path, k, block, {D.n_tokens('block')} AS w, string_split_regex({D.stripped('block')}, '\\r\\n|[\\n\\r\\x0b\\x0c]') AS ln FROM b1),
b AS MATERIALIZED (SELECT path, k, block, w, CASE WHEN {_has(D.stripped('block'), cleaning.RESIDUAL_HEADER, '(?im)')} THEN 'noise'
  WHEN {_has(_FIRST_LINE, cleaning.GREETING)} OR len(ln) <= 2 AND {_has(_FIRST_LINE, cleaning.NAME_COMMA, '')} THEN 'greeting'
  WHEN len(ln) <= 2 AND ({_has(_FIRST_LINE, cleaning.SIGNOFF)} OR {_has(_FIRST_LINE, cleaning.BARE_NAME, '')}) THEN 'signoff' ELSE 'body' END AS kind FROM b2),
f AS (
  SELECT path, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS number, CAST(0 AS BIGINT) AS own FROM b GROUP BY path
  UNION ALL
  SELECT b.path, b.k, CASE WHEN x.held >= 40 AND kind = 'body' OR x.size >= 700 AND kind = 'body' THEN 0 ELSE x.held END,
    CASE WHEN (x.held >= 40 OR x.size >= 700) AND kind = 'body' THEN 0 ELSE x.size END, x.number, x.own
  FROM f JOIN b ON b.path = f.path AND b.k = f.k + 1, LATERAL (SELECT
    CASE kind WHEN 'noise' THEN 0 WHEN 'greeting' THEN 1 WHEN 'signoff' THEN 0 ELSE f.held + 1 END AS held,
    CASE kind WHEN 'greeting' THEN w WHEN 'body' THEN f.size + w ELSE 0 END AS size,
    CASE WHEN kind = 'greeting' OR kind = 'body' AND f.held = 0 THEN f.number + 1 ELSE f.number END AS number,
    CASE WHEN kind = 'noise' OR kind = 'signoff' AND f.held = 0 THEN 0 WHEN kind = 'greeting' OR kind = 'body' AND f.held = 0 THEN f.number + 1 ELSE f.number END AS own) x),
m AS (SELECT path, own, string_agg(block, chr(10) || chr(10) ORDER BY k) AS text FROM f JOIN b USING (path, k) WHERE own > 0 GROUP BY 1, 2),
l AS (SELECT path, own, string_split(text, chr(10)) AS ls FROM m),
e AS (SELECT path, own, ls, coalesce(list_position(list_transform(ls, lambda x: {_has('x', cleaning.FORWARDED)}), true), 0) AS first FROM l),
c AS (SELECT path, own, array_to_string(list_filter(CASE WHEN first > 0 THEN list_slice(ls, 1, first - 1) ELSE ls END, lambda x: NOT {_has('x', _LOST)}), chr(10)) AS text FROM e)
SELECT path, CAST(own - 1 AS INT) AS position, {D.n_tokens(D.stripped("regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g')"))} AS n_words FROM c"""
)
def email_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Decorated texts as undelimited mail files, cut into messages and cleaned."""
    files = V.outputs(spark, sf).select(F.col("doc_id").alias("path"), "text")
    cut = cleaning.segment(files)
    return cut.select("path", "position", T.n_tokens(cleaning.clean_message(F.col("text"))).alias("n_words"))


@query(
    f"""WITH RECURSIVE m AS (SELECT user_id AS channel, ts, CASE WHEN event_type IN ('click', 'view') THEN 'a' ELSE 'b' END AS author,
  {D.n_tokens("concat_ws(' ', event_type, props)")} AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (
  SELECT channel, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS author, CAST(NULL AS TIMESTAMP) AS ts, CAST(0 AS BIGINT) AS n_messages,
    CAST(0 AS BIGINT) AS words FROM m GROUP BY channel
  UNION ALL
  SELECT m.channel, m.k, CASE WHEN x.same THEN f.turn ELSE f.turn + 1 END, m.author, CAST(m.ts AS TIMESTAMP), CASE WHEN x.same THEN f.n_messages + 1 ELSE 1 END,
    CASE WHEN x.same THEN f.words + m.n ELSE m.n END
  FROM f JOIN m ON m.channel = f.channel AND m.k = f.k + 1, LATERAL (SELECT coalesce(m.author = f.author AND epoch_us(CAST(m.ts AS TIMESTAMP)) - epoch_us(f.ts) <= 43200000000
    AND f.n_messages < 5 AND f.words < 40, false) AS same) x)
SELECT channel, turn, any_value(author) AS author, max(n_messages) AS n_messages FROM f WHERE k > 0 GROUP BY 1, 2"""
)
def chat_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user's channel as chat messages, authors taken in twos, merged into turns."""
    author = F.when(F.col("event_type").isin("click", "view"), "a").otherwise("b")
    chat = V.table(spark, sf, "events").select(
        F.col("user_id").alias("channel"), "ts", F.col("event_id").alias("seq"), author.alias("author"), F.concat_ws(" ", "event_type", "props").alias("text")
    )
    found = cleaning.turns(chat, gap_s=12 * 3600.0, most_messages=5, most_words=40)
    return found.select("channel", F.col("turn").cast("bigint").alias("turn"), "author", F.col("n_messages").cast("bigint").alias("n_messages"))


@query(
    f"""WITH q AS (SELECT l.quality, {D.n_tokens('d.text')} AS n FROM labels l JOIN documents d USING (doc_id))
SELECT round(corr(CAST(n AS DOUBLE), CAST(quality AS DOUBLE)), {R}) AS r, count(*) AS n FROM q"""
)
def pearson_len_quality(spark: SparkSession, sf: str) -> DataFrame:
    joined = V.table(spark, sf, "labels").join(V.table(spark, sf, "documents").select("doc_id", T.n_tokens(F.col("text")).alias("n")), "doc_id")
    return joined.agg(
        F.round(stats.pearson(F.col("n").cast("double"), F.col("quality").cast("double")), R).alias("r"), F.count("*").alias("n")
    )


@query(
    f"""WITH d AS (SELECT doc_id, text FROM documents), b AS (SELECT item_id, {D.normalised('text')} AS t FROM benchmark)
SELECT doc_id, count(*) AS items FROM d JOIN b ON contains({D.normalised('d.text')}, b.t) WHERE length(b.t) > 0 GROUP BY 1"""
)
def benchmark_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a benchmark item's normalised text."""
    return reports.contained(V.table(spark, sf, "documents"), V.table(spark, sf, "benchmark"))


@query(
    f"""{OUT}, h AS (SELECT model, domain, {D.n_tokens('text')} AS n_words, {_DASH} FROM o), hu AS ({V.HUMAN_SQL}),
hh AS (SELECT domain, {D.n_tokens('text')} AS n_words, {_DASH} FROM hu),
l AS (UNPIVOT h ON {', '.join(T.DASHES)} INTO NAME form VALUE hits), lh AS (UNPIVOT hh ON {', '.join(T.DASHES)} INTO NAME form VALUE hits),
r AS (SELECT domain, model, form, 1000.0 * sum(hits) / greatest(sum(n_words), 1) AS rate FROM l GROUP BY ALL),
q AS (SELECT domain, form, 1000.0 * sum(hits) / sum(n_words) AS human_rate FROM lh GROUP BY ALL)
SELECT domain, form, round(coalesce(human_rate, 0), {R}) AS human_rate, model, round(rate, {R}) AS rate,
CASE WHEN rate > coalesce(human_rate, 0) THEN 'above' WHEN rate < coalesce(human_rate, 0) THEN 'below' ELSE 'equal' END AS verdict FROM r LEFT JOIN q USING (domain, form)"""
)
def dash_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    def long(df: DataFrame, keys: list[str]) -> DataFrame:
        rows = df.select(*keys, T.n_tokens(F.col("text")).alias("words"), *[c.alias(k) for k, c in T.dash_hits(F.col("text")).items()])
        return rows.unpivot([*keys, "words"], list(T.DASHES), "form", "hits")

    human = long(V.human(spark, sf), ["domain"]).groupBy("domain", "form").agg((1000 * F.sum("hits") / F.nullif(F.sum("words"), F.lit(0))).alias("human_rate"))
    return _rounded(reports.dash_table(long(V.outputs(spark, sf), ["model", "domain"]), human))


@query(
    """SELECT doc_id, md5(regexp_replace(regexp_replace(replace(replace(replace(concat('**', doc_id, '** & <b> `x', doc_id, '` ', replace(text, '*', '')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
  '\\*\\*([^*]+)\\*\\*', '<b>\\1</b>', 'g'), '`([^`]+)`', '<code>\\1</code>', 'g')) AS digest FROM documents"""
)
def page_markup(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as small Markdown, their own asterisks left out, since DuckDB's patterns can't look ahead."""
    raw = F.concat(F.lit("**"), F.col("doc_id").cast("string"), F.lit("** & <b> `x"), F.col("doc_id").cast("string"), F.lit("` "), F.replace("text", F.lit("*"), F.lit("")))
    return V.table(spark, sf, "documents").select("doc_id", F.md5(T.mini_markdown(raw)).alias("digest"))


@query(
    f"""{OUT}, h AS (SELECT model, domain, {D.n_tokens('text')} AS n_words, {_TELLS} FROM o), hu AS ({V.HUMAN_SQL}),
hh AS (SELECT domain, {D.n_tokens('text')} AS n_words, {_TELLS} FROM hu),
l AS (UNPIVOT h ON {', '.join(T.TELLS)} INTO NAME tell VALUE hits), lh AS (UNPIVOT hh ON {', '.join(T.TELLS)} INTO NAME tell VALUE hits),
r AS (SELECT domain, model, tell, 1000.0 * sum(hits) / sum(n_words) AS rate FROM l GROUP BY ALL), q AS (SELECT domain, tell, 1000.0 * sum(hits) / sum(n_words) AS base FROM lh GROUP BY ALL)
SELECT domain, model, tell, round(CASE WHEN rate / nullif(base, 0) <= 1 THEN 0.0 ELSE least(100.0, 100 * ln(rate / nullif(base, 0)) / ln(20)) END, {R}) AS score
FROM r JOIN q USING (domain, tell) WHERE base > 0"""
)
def marker_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The logarithmic score of each tell that people have at all."""
    def pooled(df: DataFrame, keys: list[str]) -> DataFrame:
        rows = df.select(*keys, T.n_tokens(F.col("text")).alias("n"), *[c.alias(k) for k, c in T.tell_hits(F.col("text")).items()])
        sums = rows.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(t).alias(t) for t in T.TELLS]).unpivot([*keys, "n"], list(T.TELLS), "tell", "hits")
        return sums.select(*keys, "tell", (1000 * F.col("hits") / F.nullif(F.col("n"), F.lit(0))).alias("rate"))

    human = pooled(V.human(spark, sf), ["domain"]).withColumnRenamed("rate", "base").where("base > 0")
    found = pooled(V.outputs(spark, sf), ["model", "domain"]).join(F.broadcast(human), ["domain", "tell"])
    return _rounded(found.select("domain", "model", "tell", T.marker_score(F.col("rate"), F.col("base")).alias("score")))


@query(
    f"""WITH c AS (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2)
SELECT a.label AS a, b.label AS b, round(sqrt(sum((a.m - b.m) * (a.m - b.m))), 4) AS distance
FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2"""
)
def centroid_distances(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    means = rows.groupBy("label", "i").agg(F.avg("v").alias("m"))
    right = means.select(F.col("label").alias("b"), "i", F.col("m").alias("n"))
    pairs = means.withColumnRenamed("label", "a").join(right, "i").where("a < b")
    return pairs.groupBy("a", "b").agg(F.round(F.sqrt(F.sum((F.col("m") - F.col("n")) ** 2)), 4).alias("distance"))


