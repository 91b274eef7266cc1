"""Training-data operators (documents in, decisions or token ids out).

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
