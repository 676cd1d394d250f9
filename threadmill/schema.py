"""Row types and closed value sets of posts, narrative units and notes."""

from __future__ import annotations

from pyspark.sql import types as T

# The closed value sets.
COUNTRIES = ["CHI", "JPN", "KOR"]
LANGUAGES = ["zh", "ja", "ko"]
RELEVANCE = ["R1", "R0", "RU"]
EXPERIENCERS = ["E1", "E2", "E3"]
FUNCTIONS = ["C1", "C2", "C3", "C4", "C5"]
DOMAINS = ["Perceived Cause", "Symptom Description", "Perceived Consequences", "Coping and Management", "Emotional Expression"]
CONCEPT_STATUS = ["existing_dictionary", "new_candidate", "unmapped"]
SUPPORT_TYPES = ["explicit", "implicit", "unsupported"]
ASSERTIONS = ["present", "negated", "uncertain", "planned"]
TEMPORALITIES = ["past", "current", "future", "unknown"]
OUTCOMES = ["effective", "ineffective", "positive", "negative", "neutral", "unknown"]
VERDICTS = ["accept", "revise", "reject", "needs_human_review"]
#: Key on read -> column; of several keys present in a row the first named counts.
POST_ALIASES = {"post_id": ["post_id", "record_id"], "original_text": ["original_text", "text"]}
UNIT_ALIASES = {"evidence_span_original": ["evidence_span_original", "evidence_span"], "surface_text_working": ["surface_text_working", "surface_text_original", "surface_text"], "normalized_concept_en": ["normalized_concept_en", "normalized_concept"]}

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


POST = _struct(
    post_id=_S, country=_S, language=_S, platform=_S, original_title=_S, original_text=_S, text_clean=_S, text_length_chars=_I, text_fingerprint=_S,
    analysis_text_en=_S, source_file=_S, source_sheet=_S, source_row_number=_I, length_band=_S, country_length_tertile_cutpoints=T.MapType(_S, _S),
)
UNIT = _struct(
    unit_id=_S, domain=_S, evidence_span_original=_S, surface_text_working=_S, working_language=_S, normalized_concept_en=_S, concept_status=_S,
    support_type=_S, assertion=_S, temporality=_S, sentiment_or_outcome=_S, confidence=_D, judge_verdict=_S,
)
EXTRACTION = T.StructType([*POST.fields, T.StructField("relevance_label", _S), T.StructField("experiencer_label", _S), T.StructField("content_function", _S), T.StructField("units", T.ArrayType(UNIT))])
NOTE = _struct(
    keyword=_S, note_id=_S, title=_S, content=_S, author_name=_S, author_id=_S, liked_count=_L, collected_count=_L, comment_count=_L, share_count=_L,
    publish_time=_S, images=_S, video_url=_S, hashtags=_S, source_url=_S, created_at=_S,
)
