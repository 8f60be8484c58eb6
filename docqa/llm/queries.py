"""The registered queries of the training-data operators."""

from docqa.llm import alignment, embeddings, huffman, licenses, mixing, packing, private, quality, rules, secrets, simhash, spelling, tokens

MODULES = [secrets, licenses, simhash, embeddings, rules, packing, mixing, private, tokens, quality, alignment, spelling, huffman]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
