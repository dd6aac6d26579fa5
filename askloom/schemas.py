"""Table schemas and settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Config:
    """Settings of all jobs; the defaults are those of the system that this library replaces."""

    chunk_size: int = 500
    chunk_overlap: int = 100
    dimension: int = 384
    ngram: int = 3
    top_k: int = 5
    candidate_multiplier: int = 4
    min_similarity: float = 0.05
    grounding_threshold: float = 0.18
    reference_penalty: float = 0.35
    max_upload_bytes: int = 25 * 1024 * 1024
    history_limit: int = 500
    extensions: tuple[str, ...] = ("pdf", "docx", "txt")
    min_occurrences: int = 4
    max_sources: int = 3
    snippet_chars: int = 260
    source_snippet_chars: int = 320
    max_sentences: int = 3
    max_answer_chars: int = 900
    min_sentence_chars: int = 25
    preview_chars: int = 4000


DEFAULT = Config()

# Words that carry no topic. Function words first, then words of conversation and request.
STOP_WORDS = tuple(
    dict.fromkeys(
        """
    a an and are as at be but by do does for from had has have how in into is it its of on or that the their then there
    these this to was were what when where which who why will with you your
    about also am any briefly brief can could detail details describe did do explain explaination give hello hey hi i if im
    info information is kind know like looking may me mine much my need of please question regarding relate related say
    should simple so some something summarise summarize summary tell thanks thank understand us want well would
    """.split()
    )
)

# Messages that callers compare.
NO_ANSWER = "The uploaded documents do not contain enough information to answer this question."
EMPTY_CORPUS = (
    "No documents have been uploaded yet, so there is nothing to search. "
    "Upload a PDF, DOCX or TXT file and ask your question again."
)
#: What a model is told; only the message in it is fixed.
INSTRUCTION = (
    "Use nothing but the numbered sources below, and name those that you use.\n"
    f"Where they do not hold the answer, say exactly this and no more:\n{NO_ANSWER}\n\n"
)

_S, _I, _L, _D, _B, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


SEGMENTS = _table(doc_id=_S, page=_I, seq=_I, text=_S)
WORDS = _table(doc_id=_S, page=_I, page_width=_D, text=_S, x0=_D, x1=_D, top=_D)
BLOCKS = _table(doc_id=_S, seq=_I, kind=_S, style=_S, text=_S, cells=T.ArrayType(_S))
CHUNKS = _table(chunk_id=_S, doc_id=_S, filename=_S, chunk_index=_I, text=_S, char_start=_I, char_end=_I, char_count=_I, page=_I, is_reference=_B)
VECTORS = T.StructType([*CHUNKS.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embedding_model", _S)])
REGISTRY = _table(
    id=_S, filename=_S, extension=_S, size_bytes=_L, size_display=_S, status=_S, uploaded_at=_TS, updated_at=_TS, chunk_count=_I, page_count=_I,
    char_count=_L, word_count=_L, fingerprint=_S, content_type=_S, stored_filename=_S, error=_S, processing_ms=_D, embedding_model=_S,
)
SOURCE = _table(document_id=_S, filename=_S, chunk_index=_I, page=_I, snippet=_S, score=_D)
HISTORY = T.StructType(
    [*_table(id=_S, question=_S, answer=_S, confidence=_D, confidence_label=_S, response_time_ms=_D, created_at=_TS, llm_model=_S, top_score=_D).fields, T.StructField("sources", T.ArrayType(SOURCE))]
)
REJECTS = _table(filename=_S, code=_S, reason=_S)
STAGE_METRICS = T.StructType([*_table(run_id=_S, doc_id=_S, stage=_S, status=_S, duration_ms=_D, detail=_S).fields, T.StructField("metrics", T.MapType(_S, _S))])
