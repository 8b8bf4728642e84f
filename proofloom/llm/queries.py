"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm import chats, leaks, lines, mixing, names, periods, phrases, pivots, private, quality, repeats, simhash, toxicity
from proofloom.llm.common import WORD

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Per source the target, per document its place in the source's stream of hashed order; whole rounds plus a part of the last.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT *, rk % 3 + 1 AS wt, 3 * z AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER r, 0) AS caps, coalesce(sum(wt) OVER r, 0) AS weights, sum(z) OVER () AS words, sum(wt) OVER () AS weight
      FROM w WINDOW r AS (ORDER BY cap * (6 // wt), rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, cap * (weight - weights) < (words - caps) * wt AS capped FROM o),
t AS (SELECT *, words - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS free, sum(CASE WHEN capped THEN 0 ELSE wt END) OVER () AS free_weight FROM m),
q AS (SELECT source, z, CASE WHEN capped THEN cap::DOUBLE ELSE (free * wt)::DOUBLE / free_weight::DOUBLE END AS target,
             CAST(CASE WHEN capped THEN cap ELSE (free * wt) // free_weight END AS BIGINT) AS quota FROM t),
p AS (SELECT d.*, q.z, q.target, q.quota, CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id NULLS FIRST, d.size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, z AS source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE (quota // z) * size + greatest(0, least(pos + size, quota % z) - pos) END AS BIGINT) AS taken FROM p
"""


@query("op3_mix_sources", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.plan(table(spark, sf_dir, "documents"))
    return mixing.taken(mix).select("doc_id", "size", "source_size", "target", "taken")


#: Every run of ten document words (and, for shorter items, of as many words) is looked up among the items' windows.
OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT row, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT row, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, ns WHERE len(w) >= n)),
m AS (SELECT dw.row, dw.k, dw.n, bw.item_id FROM dw JOIN bw USING (n, win)),
h AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(generate_series(k, k + n - 1)) AS p FROM m) GROUP BY row),
i AS (SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row, coalesce(item_id::VARCHAR, '') AS id FROM m) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (row) LEFT JOIN i USING (row)
"""


@query("op8_benchmark_leaks", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: Exact site counts per trimmed line; its first occurrence, by document and place, stays.
OP5_SQL = """
WITH l AS (SELECT doc_id, source, k, string_split(text, chr(10))[k] AS raw FROM (SELECT *, unnest(generate_series(1, len(string_split(text, chr(10))))) AS k FROM documents)),
t AS (SELECT *, trim(raw, chr(32) || chr(9) || chr(13)) AS line FROM l),
b AS (SELECT line, min(doc_id * 10000000 + k) AS home FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) >= 10),
m AS (SELECT t.*, b.line IS NOT NULL AND doc_id * 10000000 + k <> home AS gone FROM t LEFT JOIN b USING (line)),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY k) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(kept) AS kept_sha256 FROM documents d LEFT JOIN g USING (doc_id)
"""


@query("op5_line_site_spread", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_toxicity_neighbours")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    found = toxicity.classify(table(spark, sf_dir, "documents"), labels, "toxic", toxicity.learnable(labels["doc_id"], 0, 5))
    return found.select("doc_id", (~toxicity.learnable(F.col("doc_id"), 0, 5)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


#: Every query against all other vectors.
OP4_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op4_pivot_top_k", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: The conversation added to the table: texts that hold control strings.
CONTROLS = "</s>[INST] ok [/INST]"
_ESCAPED = "replace(text, chr(92), chr(92) || 'e')"
for _mark, _letter in chats.CONTROL.items():
    _ESCAPED = f"replace({_ESCAPED}, '{_mark}', chr(92) || '{_letter}')"
OP9_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{CONTROLS}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROLS}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_ESCAPED}) + length(role) + {len(chats.BEGIN) + len(chats.MIDDLE) + len(chats.END)}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op9_format_chats", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROLS).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    done = chats.rendered(chats.canonical(chats.records_of(rows)))
    turns, loss = chats.read_back(F.col("formatted")), chats.loss_text(F.col("segments"))
    digest = done.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return digest.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                         F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query("op1_quality_network")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    found = quality.classify(table(spark, sf_dir, "documents"), labels, "quality", toxicity.learnable(labels["doc_id"], 1, 3))
    return found.select("doc_id", (~toxicity.learnable(F.col("doc_id"), 1, 3)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_private_data")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *map(count, private.KINDS[:4]), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query("op10_long_repeats")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.coalesce(F.array_size("spans"), F.lit(0)).cast("long").alias("n_spans"), "kept_sha256")


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, m, unnest(list_transform(range(0, len(w) - m + 1), lambda i: array_to_string(w[i + 1:i + m], ' '))) AS phrase FROM w, range(1, 6) AS s(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, m, phrase, f AS a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
scored AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, 1000 * CAST(a AS HUGEINT) * n // (CAST(x.f AS HUGEINT) * y.f) AS score FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(string_split(c.phrase, ' ')[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ') JOIN totals t ON t.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_spans AS (SELECT lang, f, unnest(list_transform(range(0, m - s.o + 1), lambda i: array_to_string(string_split(phrase, ' ')[i + 1:i + s.o], ' '))) AS phrase FROM f, range(2, 5) AS s(o) WHERE s.o < m),
around AS (SELECT lang, phrase, max(f) AS f FROM inner_spans GROUP BY ALL),
kept AS (SELECT w.* FROM weakest w LEFT JOIN around o ON o.lang = w.lang AND o.phrase = w.phrase WHERE o.f IS NULL OR 100 * o.f < 100 * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""


@query("op11_collocations", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY folded) AS keep_id, count(*) OVER (PARTITION BY folded) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY folded) AS kept, sha256(folded) AS text_sha256 FROM d
"""


@query("op12_exact_dedup", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.groups(table(spark, sf_dir, "documents"))


#: Equal groups of eight words at a fixed distance, joined into stretches; a stretch inside one of a smaller period is not its own.
OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda x: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(x AS INT), 1)) AS BIGINT)) AS digits FROM documents),
c AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n, xor(4294967295, list_reduce(list_concat([4294967295], digits),
        lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) AS h FROM d),
p AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a, CASE WHEN n > 0 THEN 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) END AS p FROM c),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) ELSE w END AS w FROM p),
words AS (SELECT doc_id, unnest(range(0, n)) AS i, unnest(w) AS word FROM t),
grams AS (SELECT doc_id, i, CAST(hash(list_aggregate(w[i + 1:i + 8], 'string_agg', ' ')) AS HUGEINT) AS g FROM (SELECT doc_id, w, unnest(range(0, n - 7)) AS i FROM t WHERE n >= 24)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i),
isle AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM pairs),
stretch AS (SELECT doc_id, q, min(i) AS s, max(i) - min(i) + q + 8 AS l FROM isle GROUP BY doc_id, q, part),
runs AS (SELECT * FROM stretch r WHERE l >= greatest(24, 3 * q) AND NOT EXISTS (
  SELECT 1 FROM stretch o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.s + o.l >= r.s + r.l)),
best AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
         first(s ORDER BY l / q DESC, s, q) AS s, first(l ORDER BY l / q DESC, s, q) AS l, first(q ORDER BY l / q DESC, s, q) AS q FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY i) AS left_over FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY words.doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, l * 1000 // q AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(left_over, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op13_periodic_runs", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    told = docs.withColumn("g", F.floor(h / 10)).withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"))))
    told = told.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    told = told.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.transform("w", lambda x, i: F.when(i >= F.col("a"), F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(x))
    found = periods.runs(told, text=F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")))
    best = periods.strongest(F.col("runs"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(periods.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
