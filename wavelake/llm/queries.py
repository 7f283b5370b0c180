"""The registered queries of the operators of this subpackage, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from . import bpe_chunks, embed_tiles, exact_dedup, fm_quality, html_paths, license_diagonals, minhash, mixing, phrase_mining, pii_anchors, piece_spans, prefix_trie, trie_counts
from .common import SPACE_WORD, read_table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file is on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(ship(spark), sf_dir, "documents"), words=3, percent=85).drop("class_id")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extract(read_table(ship(spark), sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.token_counts(read_table(ship(spark), sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(ship(spark), sf_dir, t) for t in ("documents", "labels"))
    return fm_quality.scores(docs, fm_quality.learn(docs, labels))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label(read_table(ship(spark), sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read_table(ship(spark), sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mix_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6 that SQL can state: the size of each document, its source's size and target."""
    return op6_mixing(spark, sf_dir).drop("taken")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.round_trip(read_table(ship(spark), sf_dir, "documents"), tokenizer_path())


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_tiles.near_duplicates(read_table(ship(spark), sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_diagonals.scan(read_table(ship(spark), sf_dir, "documents")).drop("spans")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_anchors.scan(read_table(ship(spark), sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(read_table(ship(spark), sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.with_shared_heads(read_table(ship(spark), sf_dir, "conversations")))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_spans.round_trip(read_table(ship(spark), sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_html": op2_html,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_mixing": op6_mixing,
    "op7_bpe": op7_bpe,
    "op8_embeddings": op8_embeddings,
    "op9_license_scan": op9_license_scan,
    "op10_pii": op10_pii,
    "op11_collocations": op11_collocations,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_sentencepiece": op13_sentencepiece,
    "mix_sizes": mix_sizes,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The crc32 of a decimal number's text: eight steps for each byte, the first of which takes the byte in.
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [ascii(x)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
          lambda c, b: xor(xor(c, b) >> 1, 3988292384::UBIGINT * (xor(c, b) & 1))), 4294967295::UBIGINT)"""

_GRAMS = ", ".join(f"({t}, {str(exact).lower()}, '{label}', {at}, {n}, '{gram}')" for t, exact, label, at, n, gram in license_diagonals.template_rows())

ORACLE: dict[str, str] = {
    "op1_minhash": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n m ON m.doc_id = x JOIN n k ON k.doc_id = y WHERE 100 * c >= 85 * (m.n + k.n - c)),
        r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        q AS (SELECT x, min(y) AS y FROM r GROUP BY x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(q.y, d.doc_id)) AS component_id,
               d.doc_id <= coalesce(q.y, d.doc_id) AS kept
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN q ON q.x = d.doc_id""",
    "op9_license_scan": rf"""
        WITH g(template, exact, label, t_pos, t_grams, gram) AS (VALUES {_GRAMS}),
        d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array({_LOWER}, '{license_diagonals.SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
        p AS (SELECT row, w, unnest(range(0, len(w) - 2)) AS pos FROM d),
        v AS (SELECT row, pos, g.* FROM p JOIN g ON g.gram = w[pos + 1] || ' ' || w[pos + 2] || ' ' || w[pos + 3]),
        a AS (SELECT DISTINCT row, template, exact, pos - t_pos AS diagonal FROM v),
        j AS (SELECT *, coalesce(CASE WHEN exact OR diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) > {license_diagonals.NEAR} THEN 1 ELSE 0 END, 1) AS jump FROM a),
        s AS (SELECT row, template, diagonal, sum(jump) OVER (PARTITION BY row, template ORDER BY diagonal) AS span FROM j),
        m AS (SELECT v.row, exact, label, t_grams, count(DISTINCT t_pos) / t_grams AS share, min(pos) AS first, max(pos) AS last
              FROM v JOIN s ON s.row = v.row AND s.template = v.template AND s.diagonal = v.pos - v.t_pos GROUP BY v.row, v.template, exact, label, t_grams, span),
        k AS (SELECT *, CASE WHEN exact THEN share = 1 ELSE share >= {license_diagonals.COVERED} AND last - first < t_grams + {4 * license_diagonals.NEAR} END AS good FROM m)
        SELECT d.doc_id, len(any_value(d.w)) AS n_words, count(*) FILTER (good AND exact) AS n_base,
               min(first) FILTER (good AND exact) AS first_word, max(first) FILTER (good AND exact) AS last_word,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (good AND exact), '') AS base_labels,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (good), '') AS labels,
               coalesce(max(share), 0.0) AS score
        FROM d LEFT JOIN k ON k.row = d.row GROUP BY d.row, d.doc_id""",
    "mix_sizes": rf"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACE_WORD}')) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS total, 1.0 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
        r AS (SELECT *, {mixing.MOST_REPEATS} * total / weight AS limit_, row_number() OVER (ORDER BY {mixing.MOST_REPEATS} * total / weight, encode(source) NULLS LAST) AS place FROM s),
        c AS (SELECT *, sum(total) OVER () - coalesce({mixing.MOST_REPEATS} * sum(total) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
              sum(weight) OVER (ORDER BY place DESC) AS weights FROM r),
        f AS (SELECT min(place) AS first_open FROM c WHERE rest * weight / weights <= {mixing.MOST_REPEATS} * total),
        o AS (SELECT rest, weights FROM c WHERE place = (SELECT first_open FROM f)),
        t AS (SELECT source, total, CASE WHEN place < (SELECT first_open FROM f) THEN {mixing.MOST_REPEATS} * total ELSE (SELECT rest FROM o) * weight / (SELECT weights FROM o) END AS target FROM r)
        SELECT doc_id, size, CAST(total AS BIGINT) AS source_size, target FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source""",
    "op8_embeddings": """
        WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        u AS (SELECT * FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
        n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
        r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        q AS (SELECT x, min(y) AS y FROM r GROUP BY x)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(q.y, e.vec_id)) AS component_id, e.vec_id <= coalesce(q.y, e.vec_id) AS kept
        FROM e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN q ON q.x = e.vec_id""",
    "op5_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op12_prefix_trie": rf"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role, text) AS s FROM c GROUP BY conv_id),
        h AS (SELECT conv_id, s, CAST({_CRC} % {prefix_trie.HEADS} AS INT) AS h FROM o),
        r AS (SELECT a.conv_id, list_concat(coalesce(b.s[1:h], []), a.s[h + 1:]) AS s FROM h a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % {prefix_trie.FAMILY}),
        p AS (SELECT conv_id, unnest(range(0, len(s) + 1)) AS depth, s FROM r),
        n AS (SELECT s[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
              sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(s) = depth), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
        k AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
        m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.p[depth].t, '{SPACE_WORD}')) END AS own FROM n LEFT JOIN k ON k.p = n.p),
        a AS (SELECT p, unnest(range(0, depth + 1)) AS up, n_children, own FROM m),
        t AS (SELECT p[1:up] AS p, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM a GROUP BY 1)
        SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, t.n_leaves, t.saved_tokens, m.ends_sha256
        FROM m JOIN t ON t.p = m.p LEFT JOIN n q ON m.depth > 0 AND q.p = m.p[1:m.depth - 1]""",
    "op11_collocations": rf"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
        g AS (SELECT lang, k AS words, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, range(1, {phrase_mining.LONGEST + 1}) t(k)),
        f AS (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang),
        c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE words > 1 AND f >= {phrase_mining.LEAST}),
        u AS (SELECT lang, phrase, w, a, unnest(range(1, len(w))) AS k FROM c),
        s AS (SELECT u.lang, u.phrase, a, k, x.f AS l, y.f AS r, CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS score FROM u
              JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(w[:k], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
        b AS (SELECT lang, phrase, a, min({{'score': score, 'k': k, 'l': l, 'r': r}}) AS cut FROM s GROUP BY ALL),
        i AS (SELECT lang, unnest(flatten(list_transform(range(2, len(w)), lambda n: list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))))) AS phrase, a FROM c WHERE len(w) > 2),
        m AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL),
        k AS (SELECT b.lang, b.phrase, b.a, cut FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < {phrase_mining.COVERED} * CAST(b.a AS HUGEINT)),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, phrase) AS rank FROM k)
        SELECT o.lang, rank, phrase, a, cut.l AS l, cut.r AS r, n, CAST(cut.score AS BIGINT) AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= {phrase_mining.TOP}""",
}
