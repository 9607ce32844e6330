"""Registered queries of the subpackage and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import align, bagminhash, bpe, chat, contentsort, kdtree, kmeanstree, langid, licenses, merkle, packing, ring, toxicity
from gleaner.llm.common import table
from gleaner.session import cut_lineage

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[function.__name__] = function
    return function


@register
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, decoded again."""
    definition = bpe.load_definition(spark, tokenizer_path(TOKENIZER))
    encoded = bpe.encode(table(spark, sf_dir, "documents"), definition)
    decoded = bpe.decode(encoded, definition, ["doc_id", "n_tokens"])
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@register
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 1,024 tokens."""
    definition = bpe.load_definition(spark, tokenizer_path(TOKENIZER))
    pieces = packing.cut_pieces(table(spark, sf_dir, "documents"), definition)
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(digests)


CONTROL_CONVERSATION = "</s>[INST] ok [/INST]"


@register
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as prefix-target examples, read back from the formatted texts."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_CONVERSATION), (-1, 1, "assistant", CONTROL_CONVERSATION)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    examples = chat.example_texts(chat.expand(chat.format_conversations(turns.unionByName(hostile))))
    # Every example is read back from its own text and mask; only what was read goes on.
    read = examples.select(
        "conv_id",
        "target",
        F.char_length("text").alias("chars"),
        chat.trainable_text().alias("loss"),
        chat.parse(F.col("text")).alias("turns"),
    )
    joined = F.concat_ws("", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    digests = read.select(
        "conv_id",
        "target",
        "chars",
        "loss",
        F.struct(F.size("turns").alias("n"), F.sha2(F.encode(joined, "UTF-8"), 256).alias("sha256")).alias("turns"),
    )
    # The last example of a conversation has all of its turns.
    return (
        digests.groupBy("conv_id")
        .agg(
            F.max_by("turns", "target").alias("turns"),
            F.array_sort(F.collect_list(F.struct("target", "loss"))).alias("parts"),
            F.sum("chars").cast("bigint").alias("formatted_chars"),
        )
        .select("conv_id", "turns", F.concat_ws("", F.col("parts.loss")).alias("loss"), "formatted_chars")
        .select(
            "conv_id",
            F.col("turns.n").cast("bigint").alias("n_turns"),
            F.col("turns.sha256").alias("turns_sha256"),
            F.char_length("loss").cast("bigint").alias("loss_chars"),
            F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )


def license_columns(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        "doc_id",
        "n_sentences",
        F.size("sentence_ids").cast("bigint").alias("n_known"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join(F.col("places").cast("array<string>"), ",").alias("places"),
        F.array_join("licenses", ",").alias("licenses"),
    )


@register
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that whole texts name or contain, with sentences that end at line ends."""
    return license_columns(licenses.scan(table(spark, sf_dir, "documents")))


@register
def op4_licenses_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that whole texts name or contain, with sentences that may be wrapped or commented."""
    return license_columns(licenses.scan_texts(table(spark, sf_dir, "documents")))


@register
def op6_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on a ring of eight shards with bounded loads."""
    return ring.bounded_ring(table(spark, sf_dir, "documents"), shards=8)


@register
def op7_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are equal but for white space."""
    return contentsort.content_groups(table(spark, sf_dir, "documents"))


def held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % modulus == remainder


@register
def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; learned from three quarters of the documents."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out(4, 2))
    return langid.predict(docs.withColumn("held_out", held_out(4, 2)), model, ["doc_id", "held_out"])


@register
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; learned from the labels of four fifths of the documents."""
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    scored = toxicity.score(docs.withColumn("held_out", held_out(5, 0)), net, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@register
def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose five-word shingle multisets overlap by 0.8 or more."""
    return bagminhash.near_classes(table(spark, sf_dir, "documents"))


@register
def op8_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors with the largest inner products for every twentieth vector."""
    vectors = cut_lineage(kdtree.quantised(table(spark, sf_dir, "embeddings")))
    return kdtree.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@register
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned in every whole text, with corpus counts of linked ids."""
    definition, pieces = (bpe.load_definition(spark, tokenizer_path(name)) for name in (TOKENIZER, PIECES))
    return align.align(table(spark, sf_dir, "documents"), definition, pieces)


@register
def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every hundredth vector."""
    return kmeanstree.nearest_neighbours(table(spark, sf_dir, "embeddings"), "id % 100 = 0", k=10)


@register
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents against the root; a seventh of the leaves is tampered with."""
    changed, n_chars = merkle.tampered()
    manifest = merkle.Manifest(table(spark, sf_dir, "documents"), changed, {"n_chars": n_chars})
    return merkle.proofs(manifest)


def _duck_leaf(n_chars: str) -> str:
    parts = [n_chars if c == "n_chars" else c for c in merkle.FIELDS]
    text = [f"CAST({part} AS VARCHAR)" for part in parts]
    return "sha256(" + " || ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in text) + ")"


# The checksum of a short text, bit by bit: DuckDB has no function for it.
_DUCK_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))))"""

ORACLE["op13_merkle"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_duck_leaf("n_chars")} AS leaf,
         CASE WHEN {_DUCK_CRC32} % 7 = 0 THEN {_duck_leaf("(n_chars + 1)")} END AS other
  FROM documents
), l AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY lang) AS width
  FROM d
), n AS (
  SELECT lang, 0 AS level, place, leaf AS digest, width FROM l
  UNION ALL
  SELECT lang, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (width + 1) // 2
  FROM n WHERE width > 1 GROUP BY lang, level, place // 2, width
), t AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS width
  FROM n WHERE width = 1
), u AS (
  SELECT 0 AS level, place, digest, width FROM t
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (width + 1) // 2
  FROM u WHERE width > 1 GROUP BY level, place // 2, width
), w AS (
  SELECT l.lang, l.place, k.level, coalesce(n.digest, '') AS sibling, (l.place >> k.level) & 1 AS side
  FROM l JOIN range(64) k(level) ON (1::HUGEINT << k.level) < l.width
  LEFT JOIN n ON n.lang IS NOT DISTINCT FROM l.lang AND n.level = k.level AND n.place = xor(l.place >> k.level, 1)
), v AS (
  SELECT t.lang, k.level, coalesce(u.digest, '') AS sibling, (t.place >> k.level) & 1 AS side
  FROM t JOIN range(64) k(level) ON (1::HUGEINT << k.level) < t.width
  LEFT JOIN u ON u.level = k.level AND u.place = xor(t.place >> k.level, 1)
), a AS (
  SELECT lang, place, list(side || sibling ORDER BY level) AS path FROM w GROUP BY lang, place
), b AS (
  SELECT lang, list(side || sibling ORDER BY level) AS path FROM v GROUP BY lang
), p AS (
  SELECT l.*, t.digest AS subroot, (SELECT digest FROM u WHERE width = 1) AS root,
         list_concat(coalesce(a.path, []), coalesce(b.path, [])) AS path
  FROM l JOIN t ON t.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN a ON a.lang IS NOT DISTINCT FROM l.lang AND a.place = l.place
  LEFT JOIN b ON b.lang IS NOT DISTINCT FROM l.lang
), f AS (
  SELECT *, sha256(array_to_string(list_transform(path, lambda x: substr(x, 2)), '')) AS proof_sha256,
         list_reduce(list_prepend(coalesce(other, leaf), path), lambda h, x:
           CASE WHEN x[1] = '1' THEN sha256(substr(x, 2) || h) ELSE sha256(h || substr(x, 2)) END) AS folded_root
  FROM p
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f
"""

ORACLE["op8_kdtree"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS z
  FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.z, c.z), lambda t: t[1] * t[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
) WHERE rank <= 20
"""

_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE["op7_content_sort"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), {_WHITE}, '') AS norm FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER g AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER g = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
"""


def _duck_escape(column: str) -> str:
    out = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for control in chat.CONTROL:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


ORACLE["op2_chat"] = f"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_CONVERSATION}'
  UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_CONVERSATION}'
), b AS (
  SELECT *, length('{chat.TURN}') + length({_duck_escape("role")}) + length('{chat.TEXT}')
            + length({_duck_escape("text")}) + {len(chat.END)} AS chars,
         row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS turns
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), e AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM b
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(coalesce(text, ''), '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR n = turns) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _license_oracle() -> str:
    known = ", ".join(f"('{licenses.normalised(s)}', '{i}')" for i, s in licenses.SENTENCES.items())
    names = ", ".join(
        f"('{i}', '{n}')" for i, n in {" ".join(ids): n for n, ids in reversed(licenses.RULES)}.items()
    )
    return f"""
WITH known(sentence, id) AS (VALUES {known}), named(ids, name) AS (VALUES {names}),
l AS (
  SELECT doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')),
    '{licenses.SENTENCE_END}', chr(10), 'g'), '{licenses.BETWEEN_WORDS}', ' ', 'g') AS t
  FROM documents
), s AS (
  SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS found FROM l
), u AS (
  SELECT doc_id, unnest(found) AS sentence, unnest(range(len(found))) AS place FROM s
), k AS (
  SELECT doc_id, place, coalesce(id, '{licenses.GAP}') AS id FROM u LEFT JOIN known USING (sentence)
), a AS (
  SELECT doc_id, list(id ORDER BY place) AS ids, list(place ORDER BY place) FILTER (id <> '{licenses.GAP}') AS places
  FROM k GROUP BY doc_id
), m AS (
  SELECT s.doc_id, coalesce(ids, []) AS ids, coalesce(places, []) AS places FROM s LEFT JOIN a USING (doc_id)
), r AS (
  SELECT doc_id, unnest(x) AS match, unnest(range(len(x))) AS place
  FROM (SELECT doc_id, regexp_extract_all(array_to_string(ids, ' '), '{licenses.rule_pattern(licenses.RULES)}') AS x FROM m)
), n AS (
  SELECT doc_id, string_agg(name, ',' ORDER BY place) AS licenses FROM r JOIN named ON match = named.ids GROUP BY doc_id
)
SELECT m.doc_id, CAST(len(m.ids) AS BIGINT) AS n_sentences, CAST(len(m.places) AS BIGINT) AS n_known,
       array_to_string(list_filter(m.ids, lambda x: x <> '{licenses.GAP}'), ',') AS sentence_ids,
       array_to_string(m.places, ',') AS places, coalesce(n.licenses, '') AS licenses
FROM m LEFT JOIN n USING (doc_id)
"""


ORACLE["op4_licenses"] = _license_oracle()
