"""Training-data operators (near-dedup, language ID, URL filters, WARC, search,
tokenizers, token files, quality, token counts, decontamination).

Nothing else in the library imports this subpackage; ``queries.py`` registers
its queries.
"""
