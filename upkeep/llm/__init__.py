"""Training-data operators: extraction, formatting, mixing, deduplication, BPE,
WARC, token counts, SimHash, toxicity and nearest neighbours. Nothing outside
this subpackage (and ``corpus_pipeline.py``) imports it."""
