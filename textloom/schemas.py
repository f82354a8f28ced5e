"""Table layouts shared by sources, operators and sinks."""

CHUNK = (
    "text_id string, source string, full_text string, summary string, keywords array<string>, "
    "keywords_semantic string, chunk_context string, position long, total_in_source long, "
    "source_file string, source_type string"
)
CHUNK_FIELDS = [
    "text_id", "source", "full_text", "summary", "keywords", "keywords_semantic", "chunk_context",
    "position", "total_in_source", "source_file", "source_type",
]
TERM_DOC = "struct<total:bigint,terms:array<struct<term:string,rawFreq:bigint,inDocumentsCount:bigint>>>"
PASSAGE_MAP = "map<string,string>"
TRAINING_EXAMPLE = (
    "messages array<struct<role:string,content:string>>, "
    "_meta struct<task:string,section:string,edits:string,chunk_id:string>"
)
# Fixed layout of a stored evaluation result; the order is checked before every append.
RESULT = (
    "query_id string, query string, category string, config string, task_expected string, task_got string, "
    "task_correct boolean, retrieved_ids string, search_types string, scores string, score_max double, "
    "score_min double, precision double, recall double, ceiling_precision double, n_keyword bigint, "
    "n_semantic bigint, synthesis_expected string, synthesis_got string, synthesis_correct boolean, "
    "n_verified bigint, n_approximate_quote bigint, n_displacement bigint, n_approximate_displacement bigint, "
    "n_fabrication bigint, n_source_mislabeled bigint, FA double, CA double, HD double, EC double, "
    "rubric_total double, notes string, answer string, confidence string"
)
KEYWORD_LOG = (
    "user_query string, initial_answer string, weighted_keywords string, year_keywords string, text_keywords string, "
    "text_id string, key_quote string, weighted_score double, keyword_counts string"
)
RUN = (
    "QueryID string, Query string, Category string, RerankerScoreMaxTop5 double, RerankerScoreMinTop5 double, "
    "PrecisionAt5 double, RecallAt5 double, RetrievalKeywordCountTop5 bigint, RetrievalSemanticCountTop5 bigint, "
    "RubricFactualAccuracy double, RubricCitationAccuracy double, RubricHistoriographicalDepth double, "
    "RubricEpistemicCalibration double"
)
