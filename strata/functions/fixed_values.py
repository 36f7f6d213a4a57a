"""Constants that stored results and archive files depend on."""

# Fixed values. Rolling hash table: xorshift steps from this seed, 256 entries.
GEAR_SEED, GEAR_SHIFTS = 0x5851F42D4C957F2D, (13, 7, 17)

# Fixed values. Chunk sizes: smallest, target, largest.
CHUNK_MIN, CHUNK_TARGET, CHUNK_MAX = 4096, 16384, 65536

# Fixed values. Share of repeated bytes from which a file is stored in chunks.
DEDUP_THRESHOLD = 0.10

# Fixed values. Near-duplicates: least fidelity, window of earlier chunks, bytes
# of the first look and the part of the threshold that it must reach.
FIDELITY, WINDOW, PREFIX, PREFIX_PART = 0.85, 64, 64, 0.9

# Fixed values. Dictionary: largest size, number of samples, bytes of each.
DICTIONARY_MAX, DICTIONARY_SAMPLES, DICTIONARY_SAMPLE = 65536, 16, 4096

# Fixed values. Classes of byte strings.
SPARSE, STRUCTURED, DENSE, RANDOM, NEAR_DUPLICATE = "Sparse", "Structured", "Dense", "Random", "NearDuplicate"
SPARSE_ABOVE, RANDOM_BELOW = 0.80, 0.15
STRUCTURED_MEAN, STRUCTURED_VARIANCE = (2.5, 5.5), 3.0

# Fixed values. Codec tags.
BACKENDS = {"Identity": 0, "Zstd": 1, "Lz4": 2, "Delta": 3, "Quantized": 4, "Reference": 5}

# Fixed values. Zstandard level of each compression level; of sparse chunks; of
# quantized chunks.
ZSTD_LEVEL = {"fast": 1, "default": 3, "best": 19}
SPARSE_LEVEL, QUANTIZED_LEVEL, CLEARED_BITS = 19, 3, 2

# Fixed values. Fidelity that certificates state for lossy and lossless archives.
LOSSY_FIDELITY, LOSSLESS_FIDELITY = 0.95, 1.0

# Fixed values. Archive files.
MAGIC, VERSION, HEADER_BYTES = b"UOR\xc0MP\x01\x00", 1, 88
LOSSY, HAS_MANIFEST, HAS_CERTIFICATES, VERIFIED, SINGLE_STREAM, HAS_DICTIONARY = 1, 2, 4, 8, 16, 32
EXTENSION = ".uorc"

# Fixed values. Names of chunks, archives and certificates.
CHUNK_URN = "urn:uor:chunk:sha256:"
COMPRESSED_URN = "urn:uor:compressed:sha256:"
DERIVATION_URN = "urn:uor:derivation:sha256:"
ARCHIVE_URN = "urn:uor:archive:sha256:"
BRAILLE_IRI = "https://uor.foundation/u/"
CONTEXT = {
    "derivation": "https://uor.foundation/derivation/",
    "observable": "https://uor.foundation/observable/",
    "proof": "https://uor.foundation/proof/",
    "uor": "https://uor.foundation/",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}
