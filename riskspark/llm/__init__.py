"""Operators of a training-data pipeline: near duplicates, language, licences, token files,
decontamination, packing, toxicity, chat rendering, personal data and vector search."""
