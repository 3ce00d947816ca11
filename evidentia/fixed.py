"""Names, constants and messages that records must carry exactly so."""

# source types of units
TEXT, TRANSCRIPT, OCR, VISUAL = "text", "transcript", "ocr", "visual_observation"
# the field that says whether the scorer may see a unit
ELIGIBLE = "eligible_for_frozen_g1"
# verdicts as shown
DISPLAY = {"fake": "Fake", "real": "Real", "not_run": "NEI"}
# the scorer's response
RESPONSE = {
    "checkpoint_sha256": "b694f2d4bb5ba6f72dd8a001bd984d46853546f2a85858a812f2496af1f1a0b9",
    "variant": "G1_text_ocr",
    "contract_version": "1.0.0",
    "pooling": "max",
    "maximum_units_per_sample": 24,
    "max_length": 256,
    "selection_head_affects_sample_pooling": False,
    "topk_is_only_prediction_basis": False,
    "dropped_visual_unit_count": 0,
}
# recovery modes of an observer's reply
CANONICAL, ARRAY, SINGLE = "canonical_object", "top_level_array_wrapped", "single_observation_object_wrapped"
# reasons of the sufficiency policy
SUFFICIENT_REASON = "frozen_g1_evidence_available_and_model_completed"
INSUFFICIENT_REASON = "no_frozen_g1_eligible_evidence"
# outcomes of a run that failed, by stage
FAILURES = {"runtime": ("runtime_execution_failed", "Production runtime execution failed."), "result_packaging": ("result_packaging_failed", "Production result packaging failed.")}
# warnings
VISUAL_EXCLUDED = "supplemental visual units excluded from Frozen G1"
TRUNCATED = "official Phase4A truncation occurred"
NO_TRANSCRIPT = "ASR produced no valid transcript units"
NO_EVIDENCE = "ASR and OCR produced no Frozen G1 evidence"
VISUAL_ONLY = "visual-only evidence cannot run Frozen G1"
NO_FRAMES = "SigLIP retrieval produced no visual frames"
# producers, methods and model identities in provenance
WHISPER = ("openai/whisper-large-v3-turbo", "41f01f3fe87f28c78e2fbf8b568835947dd65ed9")
DETECTOR = ("PaddlePaddle/PP-OCRv5_server_det", "ca867c897ecbca8873081573a802ad70d499cb94")
RECOGNIZER = ("PaddlePaddle/PP-OCRv5_server_rec", "b26c3587fda8da3c8ec0ce357214b4d661ff1558")
SIGLIP = ("google/siglip2-base-patch16-384", "f775b65a79762255128c981547af89addcfe0f88")
QWEN = ("Qwen/Qwen2.5-VL-7B-Instruct", "cc594898137f460bfe9f0759e9844b3ce807cfb5")
OCR_PRODUCER = "PaddlePaddle/PP-OCRv5_server_det+PaddlePaddle/PP-OCRv5_server_rec"
PROMPT_POLICY = "claim_blind_visible_atomic_facts_no_ocr_no_inference"
EXPOSURE_PRODUCER, EXPOSURE_METHOD = "multimodal_exposure_composer", "balanced_transcript_exposure"
# stages of a case in order, and what each says when it is complete
STAGES = ("request", "session", "asr", "ocr", "visual_retrieval", "vlm", "runtime_unit_pool", "mock_g1", "result")
STAGE_DETAILS = ("request accepted", "deterministic session created", "{transcript} transcript units", "{ocr} OCR units", "{visual} visual candidates", "{visual} visual observations", "{total} total units", "{evaluated} eligible units evaluated", "result assembled")
# results and outcomes as published
SCHEMA_VERSION = 1
