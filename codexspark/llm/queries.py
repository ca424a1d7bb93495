"""The thin queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexspark.llm import collocations, embedding_dedup, fingerprints, mixing, near_dedup, pieces, pii, quality_classifier, quality_rules, repeats, token_counts, toxicity, vector_codes
from codexspark.llm.shared import table


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file; the folder can be moved with CODEXSPARK_TOKENIZERS."""
    return os.path.join(os.environ.get("CODEXSPARK_TOKENIZERS", "/opt/tokenizers"), name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = r"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, h, (length(h) // 2)::BIGINT AS n FROM texts),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM sized WHERE n >= 50)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS first FROM windows) WHERE first < doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS jump FROM late),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(jump) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM runs
  UNION ALL SELECT r.doc_id, max(r.b), any_value(s.n) FROM runs r JOIN sized s USING (doc_id) GROUP BY r.doc_id),
left_over AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM gaps JOIN sized USING (doc_id) GROUP BY doc_id),
removed AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM runs GROUP BY doc_id)
SELECT s.doc_id, s.n AS n_bytes, coalesce(r.n_removed, 0)::BIGINT AS n_removed, coalesce(r.n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(l.h, s.h))) AS kept_sha256
FROM sized s LEFT JOIN removed r USING (doc_id) LEFT JOIN left_over l USING (doc_id)
"""


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


OP3_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM sizes GROUP BY source),
weighed AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2.0::DOUBLE AS cap FROM src),
steps AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above,
         (SELECT sum(source_size) * 1.5::DOUBLE FROM src) AS budget FROM weighed),
level AS (SELECT min_by((budget - below) / above, cap / weight) AS lvl FROM steps WHERE (budget - below) / above <= cap / weight),
targets AS (SELECT source, source_size, least(cap, weight * coalesce(lvl, cap)) AS target FROM weighed, level),
lined AS (
  SELECT doc_id, key, size, source_size, target, sum(size) OVER (PARTITION BY t.sid ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS done
  FROM sizes s JOIN (SELECT targets.*, src.sid FROM targets JOIN src ON targets.source IS NOT DISTINCT FROM src.source) t ON s.source IS NOT DISTINCT FROM t.source),
queue AS (
  SELECT doc_id, key, size, done::DOUBLE / target AS finish FROM lined WHERE size > 0 AND target > 0
  UNION ALL SELECT doc_id, key, size, (done + source_size)::DOUBLE / target FROM lined WHERE size > 0 AND target > 0),
running AS (SELECT *, sum(size) OVER (ORDER BY finish, key, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM queue),
taken AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM running WHERE used <= (SELECT max(budget) FROM steps) GROUP BY doc_id)
SELECT l.doc_id, l.size, l.source_size, l.target, coalesce(t.taken, 0)::BIGINT AS taken FROM lined l LEFT JOIN taken t ON l.doc_id = t.doc_id
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits for each document: its middle twentieth is rewritten, a phrase goes in at a quarter, the end is cut."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    script = [(F.floor(n / 2), F.floor(n / 2) + F.floor(n / 20), "in other words, it's 42"), (F.floor(n / 4), F.floor(n / 4), " we'll see "), (n - F.floor(n / 50), n + 1000, None)]
    one = lambda a, b, new: F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"), F.lit(new).cast("string").alias("new"))
    got = token_counts.counted(docs.withColumn("edits", F.array(*[one(*e) for e in script])), tokenizer_file("byte_bpe_50k.tiktoken"))
    fields = [F.col(f"counts.{c}").alias(c) for c in ("n_tokens", "n_tokens_edited", "n_pretokens", "n_reencoded", "n_chars_edited")]
    return got.select("doc_id", *fields, F.sha2("counts.edited", 256).alias("edited_sha256"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l ON l.node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.tail_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    own, edited = F.col("print"), F.col("edited_print")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.printed(own).alias("fingerprint"),
        fingerprints.printed(edited).alias("edited_fingerprint"),
        fingerprints.resemblance(own, edited).alias("near_edited"),
        F.coalesce(fingerprints.resemblance(own, F.col("next_print")), F.lit(0.0)).alias("near_next"),
        fingerprints.containment(own, edited).alias("contained_in_edited"),
        fingerprints.distinct_shingles(own).alias("n_shingles_estimate"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(docs, bands=quality_rules.fitted_bands(docs)).select("doc_id", "rules.*")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", pii.pii_spans(F.col("text")).alias("found"))
    base = F.filter("found", lambda s: s["kind"].isin(*pii.BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined(F.col("found")).alias("spans"),
    )


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


OP11_SQL = r"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
                             THEN embedding::DOUBLE[] END AS v FROM embeddings),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
reach(node, other) AS (SELECT vec_id, vec_id FROM vectors UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
sums AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(s.n, 0)::BIGINT AS n_links, l.component_id, v.vec_id = l.component_id AS kept
FROM vectors v JOIN least l ON l.node = v.vec_id LEFT JOIN sums s ON s.a = v.vec_id
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes.compressed(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    rows = vector_codes.with_label_errors(rows)
    return rows.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(vector_codes.printed(books)).alias("codebooks_sha256"))


def _op12_sql() -> str:
    nearest = """SELECT vec_id, part, p, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT x.vec_id, x.part, x.p, b.entry, list_sum(list_transform(list_zip(x.p, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM parts x JOIN book{r} b USING (part)) GROUP BY ALL"""
    means = """SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{before} b LEFT JOIN (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
    SELECT part, entry, i, sum(p[i])::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, p, unnest(range(1, len(p) + 1)) AS i FROM near{before}) GROUP BY ALL) GROUP BY ALL) m USING (part, entry)"""
    steps = "".join(f",\nnear{r} AS MATERIALIZED ({nearest.format(r=r)})" + (f",\nbook{r + 1} AS MATERIALIZED ({means.format(before=r)})" if r < 4 else "") for r in range(5))
    return rf"""
WITH ints AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS p FROM ints, range(4) t(part)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM ints QUALIFY entry < 256),
book0 AS MATERIALIZED (SELECT part, entry, p AS c FROM parts JOIN first USING (vec_id)){steps},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near4 GROUP BY vec_id),
sums AS (SELECT i.label, sum(c.error)::BIGINT AS label_error FROM coded c JOIN ints i USING (vec_id) GROUP BY i.label)
SELECT c.vec_id, c.code, c.error, s.label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book4) AS codebooks_sha256
FROM coded c JOIN ints i USING (vec_id) JOIN sums s ON s.label IS NOT DISTINCT FROM i.label
"""


OP12_SQL = _op12_sql()


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
phrases AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) t(k) WHERE len(w) >= k))
  GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT p.lang, p.phrase, p.f AS a, cut, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * p.f * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM phrases WHERE k > 1) p JOIN totals t USING (lang)
  JOIN phrases l ON l.lang = p.lang AND l.k = cut AND l.phrase = array_to_string(p.w[1:cut], ' ')
  JOIN phrases r ON r.lang = p.lang AND r.k = p.k - cut AND r.phrase = array_to_string(p.w[cut + 1:], ' ')),
scored AS (SELECT lang, phrase, a, min_by({'l': l, 'r': r, 'n': n, 'score': score}, (score, cut)) AS x FROM cuts GROUP BY ALL),
open AS (
  SELECT * FROM scored s WHERE NOT EXISTS (
    SELECT 1 FROM phrases g WHERE g.lang = s.lang AND 100 * g.f >= 100 * s.a AND length(g.phrase) > length(s.phrase) AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY x.score DESC, a DESC, phrase) AS rank FROM open)
SELECT lang, rank, phrase, a, x.l AS l, x.r AS r, x.n AS n, x.score AS score FROM ranked WHERE rank <= 2000
"""


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_pieces, op3_mix_sources, op4_token_counts, op5_near_dedup, op6_quality_classifier, op7_toxicity, op8_fingerprints, op9_quality_rules, op10_pii, op11_embedding_dedup, op12_vector_codes, op13_collocations)}
ORACLES: dict[str, str] = {"op1_suffix_dedup": OP1_SQL, "op3_mix_sources": OP3_SQL, "op5_near_dedup": OP5_SQL, "op11_embedding_dedup": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_collocations": OP13_SQL}
