"""The identity protocol, version 1. They are data that existing indexes hold; changing one changes every identity."""

IDENTITY_SCHEMA = "cairn-chunk-identity-v1"
NORMALIZER = "cairn-normalizer-v1"
TOKENIZER = "word-v1"
ROLLING_HASH = "rabin64-word-v1"
BOUNDARY_RULE = "tttd-v1"

BYTES_DOMAIN = "cairn-bytes-v1"
TEXT_DOMAIN = "cairn-text-v1"
JSON_DOMAIN = "cairn-json-v1"
CHUNK_DOMAIN = "cairn-chunk-v1"
CHUNKER_PARAMS_DOMAIN = "cairn-chunker-params-v1"
MERKLE_EMPTY_DOMAIN = "cairn-merkle-empty-v1"
MERKLE_LEAF_DOMAIN = "cairn-merkle-leaf-v1"
MERKLE_NODE_DOMAIN = "cairn-merkle-node-v1"
CORPUS_DOCUMENT_DOMAIN = "cairn-corpus-document-v1"
INDEX_RECORD_DOMAIN = "cairn-index-record-v1"

EMBEDDING_PARAMS_PREFIX = b"cairn:embedding-params:v1\0"
INSTANCE_PREFIX = b"cairn:instance:v1\0"
MEASURE_CHUNK_PREFIX = b"cairn:measure:chunk:v1\0"
WORD_PERSON = b"cairn-word-v1"
HASH_FEATURE_PERSON = b"cairn-hash-v1"

RABIN_BASE = 0x100000001B3

#: Values of a chunk's ``boundary_reason`` that mean a hard cut.
HARD_REASONS = ("hard-cut", "hard_max", "max")
