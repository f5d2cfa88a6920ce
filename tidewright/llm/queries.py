"""The thin registered queries over the test tables, and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import own_folder
from .chat_format import chat_digests, format_chats
from .id_files import read_ids, write_ids
from .media_store import media_round_trip
from .near_dup import near_duplicates
from .repeats import repeated_bytes
from .secret_scan import KINDS, secret_spans
from .source_mix import mix_sources
from .token_counts import token_counts
from .toxicity import fit_toxicity, toxicity_scores
from .tree_bpe import bpe_round_trip
from .vector_codes import vector_codes
from .vector_dup import vector_duplicates
from .whitening import whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{own_folder(spark)}/id-files-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=0)
    return read_ids(spark, folder)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), total=1.5, most=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))

    def listed(spans: str) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(number, KINDS)
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op7_media_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_round_trip(table(spark, sf_dir, "documents"), least=256, usual=1024, most=16384)
    names = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature"
    return found.select(*names.split())


def op8_vector_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_bytes(table(spark, sf_dir, "documents"), length=400, keep_first=False)
    return found.drop("spans")


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_round_trip(docs, ranks, public_tokenizers.PATTERN)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    folder = f"{own_folder(spark)}/chats-{uuid.uuid4().hex}"
    format_chats(convs, folder, public_tokenizers.path("byte_bpe_50k.json"), budget=1024, history=256)
    return chat_digests(spark, folder)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(table(spark, sf_dir, "embeddings"), components=16)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4)


QUERIES = {f.__name__: f for f in (op1_id_files, op2_source_mix, op3_secret_scan, op4_toxicity, op5_near_dup, op6_token_counts, op7_media_store, op8_vector_dup, op9_repeats, op10_bpe_round_trip, op11_chat_format, op12_whitening, op13_vector_codes)}



def _vector_codes_sql(rounds: int = 4, width: int = 16) -> str:
    """Lloyd's rounds of op13 as one common table expression after another."""

    def nearest(book: str) -> str:
        return f"""SELECT vec_id, part, arg_min(entry, 256 * d + entry) AS entry, min(d) AS d FROM (
  SELECT p.vec_id, p.part, b.entry,
         CAST(list_inner_product(p.v, p.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(p.v, b.v) AS BIGINT) AS d
  FROM p JOIN {book} AS b ON p.part = b.part) GROUP BY vec_id, part"""

    means = ", ".join(f"floor(sum(v[{i}]) / count(*))" for i in range(1, width + 1))
    steps = [
        """k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda c: floor(1024 * c)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding))""",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, x[{width} * part + 1 : {width} * (part + 1)] AS v FROM k, (SELECT unnest(range(4)) AS part))",
        "f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 256)",
        "b0 AS MATERIALIZED (SELECT part, entry, v FROM p JOIN f USING (vec_id))",
    ]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({nearest(f'b{i}')})")
        steps.append(f"n{i} AS (SELECT part, entry, [{means}] AS v FROM a{i} JOIN p USING (vec_id, part) GROUP BY part, entry)")
        steps.append(f"b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n{i}.v, b{i}.v) AS v FROM b{i} LEFT JOIN n{i} USING (part, entry))")
    steps += [
        f"last AS MATERIALIZED ({nearest(f'b{rounds}')})",
        f"""h AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda c: CAST(c AS BIGINT)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256
  FROM b{rounds})""",
        """c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id)""",
    ]
    return f"""WITH {', '.join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM c JOIN k USING (vec_id), h"""


ORACLE_SQL: dict[str, str] = {
    "op13_vector_codes": _vector_codes_sql(),
    "op8_vector_dup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS norm FROM v
      WHERE x IS NOT NULL AND list_aggregate(x, 'count') = len(x) AND isfinite(list_inner_product(x, x)) AND list_inner_product(x, x) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.vec_id <> b.vec_id
      AND list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.9),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a),
r AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
""",
    "op5_near_dup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
x AS (SELECT doc_id, words, unnest(range(1, greatest(len(words), 2))) AS i FROM w WHERE len(words) > 0),
s AS (SELECT DISTINCT doc_id, concat_ws(' ', words[i], words[i + 1]) AS shingle FROM x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
""",
    "op2_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn
      FROM d GROUP BY source),
w AS (SELECT source, source_size, 2 * source_size AS most, CASE turn WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, 1.5 * sum(source_size) OVER () - coalesce(sum(most) OVER p, 0) AS left_over,
             sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS weight_left,
             row_number() OVER (ORDER BY most / CAST(weight AS DOUBLE), source NULLS LAST) AS nr
      FROM w WINDOW p AS (ORDER BY most / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT nr AS first_nr, CAST(left_over AS DOUBLE) / CAST(weight_left AS DOUBLE) AS unit FROM o
      WHERE CAST(left_over AS DOUBLE) / CAST(weight_left AS DOUBLE) * weight <= most ORDER BY nr LIMIT 1),
t AS (SELECT source, source_size,
             CASE WHEN first_nr IS NULL OR nr < first_nr THEN CAST(most AS DOUBLE) ELSE unit * weight END AS target
      FROM o LEFT JOIN f ON true),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size = 0 THEN 0 ELSE CAST(floor(t.target) AS BIGINT) // t.source_size END AS whole,
             CASE WHEN t.source_size = 0 THEN 0 ELSE CAST(floor(t.target) AS BIGINT) % t.source_size END AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + least(size, greatest(rest - before, 0)) AS BIGINT) AS taken FROM c
""",
}
