"""Text expressions, chunking and corpus counts over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant import constants as K
from verdant.functions import text as tx
from verdant.operators import search
from verdant.queries import standins as st
from verdant.queries.registry import query, table
from verdant.sources import corpus


@query("tokenise", f"""SELECT doc_id, len(t) AS token_count, len(list_distinct(t)) AS distinct_tokens, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, {st.tokens_sql('text')} AS t FROM documents)""")
def _(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return df.select(
        "doc_id", F.size("t").alias("token_count"), F.size(F.array_distinct("t")).alias("distinct_tokens"), F.md5(F.array_join("t", " ")).alias("digest")
    )


@query("normalise_text", r"SELECT page_id, md5(trim(regexp_replace(lower(html), '[\s\v]+', ' ', 'g'))) AS digest FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(tx.normalise(F.col("html"))).alias("digest"))


@query("chunk_documents", f"WITH RECURSIVE {st.CHUNKS} SELECT document_id, page_number, chunk_index, text FROM chunks")
def _(spark, sf):
    return st.chunks(spark, sf).select("document_id", "page_number", "chunk_index", "text")


@query("chunk_with_overlap", f"WITH RECURSIVE {st.OVERLAPPING} SELECT document_id, page_number, chunk_index, text FROM chunks")
def _(spark, sf):
    return corpus.ingest_pages(st.pages(spark, sf), mode="overlap")


@query("rejected_documents", f"WITH RECURSIVE {st.CHUNKS} SELECT doc_id AS document_id FROM documents WHERE doc_id NOT IN (SELECT document_id FROM chunks)")
def _(spark, sf):
    return corpus.rejected_documents(st.pages(spark, sf), st.chunks(spark, sf))


def _spaced(t: str) -> str:
    """Every non-word character doubled, so that neighbouring words do not share a separator."""
    return rf"' ' || regexp_replace(lower({t}), '([^\pL\pN_])', '\1\1', 'g') || ' '"


def _hits(words) -> str:
    counts = [rf"len(regexp_extract_all(s, '(?:^|[^\pL\pN_]){w.replace(chr(39), chr(39) * 2)}(?:[^\pL\pN_]|$)'))" for w in words if "'" not in w]
    counts += [rf"len(regexp_extract_all(s, '(?:^|[^\pL\pN_]){w.replace(chr(39), chr(39) * 4)}(?:[^\pL\pN_]|$)'))" for w in words if "'" in w]
    return " + ".join(counts)


def _language_sql(source: str, key: str) -> str:
    return rf"""SELECT {key}, CASE WHEN regexp_matches(text, '[а-яёА-ЯЁ]') THEN CASE WHEN regexp_matches(text, '[ЎўҚқҒғҲҳ]') THEN 'uz-cyrl' ELSE 'ru' END
  WHEN NOT regexp_matches(text, '[A-Za-z]') THEN NULL WHEN uz > en THEN 'uz-latn' WHEN en > uz THEN 'en' END AS language
FROM (SELECT *, {_hits(K.UZ_MARKERS)} + len(regexp_extract_all(text, 'o''|O''|G''|g''')) AS uz, {_hits(K.EN_MARKERS)} AS en
  FROM (SELECT *, {_spaced('text')} AS s FROM {source}))"""


@query("detect_language", _language_sql("documents", "doc_id"))
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.language(F.col("text")).alias("language"))


@query("answer_language", f"""WITH d AS ({_language_sql('conversations', 'conv_id, turn, role')})
SELECT conv_id, turn, coalesce(language, CASE WHEN role = 'user' THEN 'uz-latn' END) AS target FROM d""")
def _(spark, sf):
    asked = F.when(F.col("role") == "user", "uz-latn").when(F.col("role") == "system", "xx")
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.answer_language(F.col("text"), asked).alias("target"))


_KV = K.SECRET_PATTERNS[2][0].replace("'", "''").replace("(?i)", "")


def mask_sql(t: str) -> str:
    first = f"regexp_replace({t}, 'Bearer\\s+\\S+', 'Bearer ***', 'gi')"
    second = f"regexp_replace({first}, 'sk-[A-Za-z0-9_-]{{6,}}', 'sk-***', 'g')"
    third = f"regexp_replace({second}, '{_KV}', '\\1\\2***', 'gi')"
    return f"replace({third}, 'thereti', '***')"


@query("mask_secrets", f"SELECT doc_id, {mask_sql('text')} AS masked, {mask_sql('text')} <> text AS changed FROM documents")
def _(spark, sf):
    masked = tx.mask_secrets(F.col("text"), ("the", "thereti"))
    return table(spark, sf, "documents").select("doc_id", masked.alias("masked"), (masked != F.col("text")).alias("changed"))


@query("active_corpus", f"WITH RECURSIVE {st.CHUNKS} SELECT chunk_id, document_id, name AS document_name FROM chunks JOIN docs USING (document_id) WHERE is_active")
def _(spark, sf):
    return search.active_chunks(st.chunks(spark, sf), st.documents(spark, sf)).select("chunk_id", "document_id", "document_name")


@query("corpus_counts", f"""WITH RECURSIVE {st.CHUNKS} SELECT document_id, name, is_active, count(chunk_id) AS chunk_count, max(page_number) AS total_pages
FROM docs LEFT JOIN chunks USING (document_id) GROUP BY 1, 2, 3""")
def _(spark, sf):
    return search.corpus_counts(st.chunks(spark, sf), st.documents(spark, sf))
