"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark.llm.bpe_automaton import encode_documents
from meterlark.llm.decontaminate import decontaminate
from meterlark.llm.exact_dedup import exact_dedup
from meterlark.llm.fill_middle import fill_in_middle
from meterlark.llm.html_extract import extract_main_text
from meterlark.llm.language_id import identify_languages
from meterlark.llm.line_dedup import line_dedup
from meterlark.llm.minhash import near_duplicates
from meterlark.llm.periodic_runs import periodic_runs, with_planted_period
from meterlark.llm.product_quantization import near_vectors
from meterlark.llm.quality import quality
from meterlark.llm.substring import substring_dedup
from meterlark.llm.token_store import store_digests


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_digests(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).drop("bucket")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"))


def op11_product_quantization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(_table(spark, sf_dir, "documents"), outputs=False)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_period(_table(spark, sf_dir, "documents")))
    # The longest run; of equal ones the first start, then the least period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_store, op2_bpe_automaton, op3_minhash, op4_substring, op5_quality, op6_decontaminate, op7_exact_dedup, op8_language_id, op9_html_extract, op10_line_dedup, op11_product_quantization, op12_fill_middle, op13_periodic_runs, pipeline)}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [hash(w[1])]
    ELSE list_distinct([hash(w[i], w[i + 1]) FOR i IN range(1, len(w))]) END AS s FROM w
), big AS (SELECT doc_id, s, len(s) AS n FROM s WHERE len(s) > 0),
near AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS total, len(list_intersect(a.s, b.s)) AS i
  FROM big a JOIN big b ON a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), link AS (
  SELECT x, y FROM near WHERE 100 * i >= 80 * (total - i) UNION SELECT y, x FROM near WHERE 100 * i >= 80 * (total - i)
), reach AS (
  SELECT doc_id AS id, doc_id AS to_id FROM s UNION SELECT r.id, l.y FROM reach AS r JOIN link l ON r.to_id = l.x
)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.to_id) AS component_id, min(r.to_id) = s.doc_id AS kept
FROM s JOIN reach r ON r.id = s.doc_id GROUP BY s.doc_id, s.s
"""

_OP4 = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS pos, unnest([array_to_string(list_slice(w, i, i + 19), ' ') FOR i IN range(1, len(w) - 18)]) AS run
  FROM w WHERE len(w) >= 20
), later AS (
  SELECT doc_id, pos FROM win QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM later),
flat AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w),
marked AS (SELECT f.doc_id, f.pos, f.word, g.pos IS NOT NULL AS gone FROM flat f LEFT JOIN gone g USING (doc_id, pos)),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_OP6 = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, unnest([list_slice(w, i, i + least(13, len(w)) - 1) FOR i IN range(1, len(w) - least(13, len(w)) + 2)]) AS run
  FROM b WHERE len(w) > 0
), n AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n.n AS n, unnest([struct_pack(pos := i, run := list_slice(w, i, i + n.n - 1)) FOR i IN range(1, len(w) - n.n + 2)]) AS p
  FROM d, n WHERE len(w) >= n.n
), hits AS (
  SELECT dw.doc_id, dw.p.pos AS pos, dw.n, bw.item_id FROM dw JOIN bw ON dw.p.run = bw.run
), covered AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS x FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP7 = f"""
WITH t AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
FROM t WINDOW g AS (PARTITION BY text)
"""

_OP10 = rf"""
WITH l AS (
  SELECT doc_id, pos, string_split(coalesce(text, ''), chr(10))[pos] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents)
), k AS (
  SELECT *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.keep_id AS gone FROM k LEFT JOIN r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


_OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, array_to_string(list_slice(u, 1, a), '') AS prefix, array_to_string(list_slice(u, a + 1, b), '') AS middle, array_to_string(list_slice(u, b + 1, n), '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""


_OP13 = r"""
WITH c AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS h
  FROM documents
), g AS (
  SELECT doc_id, w, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % greatest(len(w), 1) AS a,
    1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p FROM c
), t AS (
  SELECT doc_id, CASE WHEN planted THEN [CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END FOR i IN range(len(w))] ELSE w END AS w FROM g
), f AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM t),
same AS (
  SELECT x.doc_id, y.i - x.i AS p, x.i AS i FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND 2 * (y.i - x.i) <= x.n
), stretch AS (
  SELECT doc_id, p, min(i) AS start, count(*) + p AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS part FROM same) GROUP BY doc_id, p, part HAVING count(*) + p >= greatest(12, 2 * p)
), runs AS (SELECT doc_id, start, length, min(p) AS p FROM stretch GROUP BY doc_id, start, length),
told AS (
  SELECT doc_id, count(*) AS n_runs, max_by(start, [length, -start, -p]) AS start, max(length) AS length, max_by(p, [length, -start, -p]) AS period,
    string_agg(start || ',' || length || ',' || p || chr(10), '' ORDER BY start, p) AS lines FROM runs GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(start + p, start + length)) AS i FROM runs),
kept AS (SELECT f.doc_id, string_agg(word, ' ' ORDER BY f.i) AS kept FROM f ANTI JOIN gone USING (doc_id, i) GROUP BY f.doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


_OP11 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS id, vec_id AS to_id FROM v UNION SELECT r.id, l.y FROM reach r JOIN link l ON r.to_id = l.x),
least AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id),
n AS (SELECT x, count(*) AS n_links FROM link GROUP BY x)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, component_id = v.vec_id AS kept FROM v JOIN least ON id = v.vec_id LEFT JOIN n ON x = v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash": _OP3, "op4_substring": _OP4, "op6_decontaminate": _OP6, "op7_exact_dedup": _OP7, "op10_line_dedup": _OP10, "op11_product_quantization": _OP11, "op12_fill_middle": _OP12, "op13_periodic_runs": _OP13}
