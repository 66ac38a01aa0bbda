"""Training-data operators: chat formatting, decontamination, fingerprints, packing,
URL filters, WARC derivatives, substring dedup, quality, language and near duplicates.

Nothing outside this subpackage imports it.
"""
