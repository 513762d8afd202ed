"""Training-data operators: secrets, mixing, near duplicates, tokens, neighbours, toxicity, PII, language, HTML, fingerprints,
tokenizer alignment, clustering, decontamination.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames; shared conventions:
null texts count as empty, extra input columns are ignored by name, repeated rows give repeated results, and
empty tables give empty results of the same schema.
"""
