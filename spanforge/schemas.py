"""Schemas of the record kinds, as DDL."""

SPEECH = "text string, span_start double, span_end double, speaker string, language string"
VISUAL = "summary string, span_start double, span_end double, granularity string, tags array<string>, entities array<string>"
OCR = "text string, span_start double, span_end double"
AUDIO = "label string, span_start double, span_end double, confidence double"
KINDS = {"speech": SPEECH, "visual": VISUAL, "ocr": OCR, "audio": AUDIO}
ACTION = "action_type string, query string, modality string, node_id string, evidence_ids array<string>, answer string, rationale string"
EVIDENCE = "evidence_id string, claim string, modality string, s double, e double, source_node_id string, confidence double, detail string"
SAMPLE = (
    "sample_id string, video_id string, task string, duration double, conversations array<struct<role string, content string, candidate_response string, "
    "criteria array<struct<description string, weight double, is_penalty boolean, criteria_met boolean>>>>"
)
CALL = "struct<root_model string, prompt string, response string, execution_time double>"
BLOCK = f"struct<code string, result struct<stdout string, stderr string, locals map<string,string>, execution_time double, rlm_calls array<{CALL}>, final_answer string>>"
ITERATION = (
    "run_id string, iteration bigint, timestamp string, prompt array<struct<role string, content string>>, response string, "
    f"code_blocks array<{BLOCK}>, final_answer string, iteration_time double"
)
