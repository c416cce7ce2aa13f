"""The query modules of this subpackage."""

from siltstone.llm import abuse, chunking, neardup, packing, provenance, secrets, survivor, syntax, tokenizer

MODULES = [chunking, syntax, provenance, neardup, survivor, secrets, tokenizer, packing, abuse]
