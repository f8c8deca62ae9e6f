"""Training-data operators: toxicity, near duplicates, URL filters, packing, extraction,
sharding, quality, decontamination, language identification and line-frequency rules.

Nothing outside this subpackage imports it.
"""
