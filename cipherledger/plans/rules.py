"""Rule tables. Patterns, weights, thresholds and texts must be these for right results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SURFACES = ("source_code", "binary", "certificate", "container", "infrastructure")
PRIORITIES = ("P1", "P2", "P3", "P4")
CATEGORIES = ("key_establishment", "digital_signature", "encryption", "hashing", "mac", "key_derivation", "random_generation")
PURPOSES = (*CATEGORIES, "certificate", "unknown")
#: Values that a fresh asset has until later stages set them.
STAGING = (("classification", "application"), ("sensitivity", "internal"), ("criticality", "low"), ("lifecycle_stage", "active"))
#: Fields that a responder must not send, fields that it may send, and the longest texts.
PROHIBITED = ("risk", "priority", "recommendation", "verdict", "severity", "urgency", "score", "mosca", "hndl", "p1", "p2", "p3", "p4")
RESPONSE_FIELDS = ("purpose", "confidence", "algorithm_hint", "context_notes")
RESPONSE_BYTES, HINT_CHARS, NOTES_CHARS, LOW_CONFIDENCE = 2048, 100, 500, 0.4
#: Kind of primitive by purpose in a bill of materials.
PRIMITIVES = (("key_establishment", "kem"), ("digital_signature", "signature"), ("encryption", "pke"), ("hashing", "hash"), ("mac", "mac"), ("key_derivation", "kdf"), ("random_generation", "drbg"), ("certificate", "pke"))
#: Registry, name, tag and digest of an image reference.
IMAGE_REF = r"^(?:([a-zA-Z0-9][a-zA-Z0-9._:-]*)/)?([a-z0-9]+(?:[._-][a-z0-9]+)*(?:/[a-z0-9]+(?:[._-][a-z0-9]+)*)*)(?::(\w[\w.-]*))?(?:@sha256:([a-f0-9]{64}))?$"
#: Names of curves and hashes in certificates, and kinds of keys that are algorithms themselves.
CURVE_NAMES = (("secp256r1", "ECDSA-P256"), ("secp384r1", "ECDSA-P384"), ("secp521r1", "ECDSA-P521"), ("secp256k1", "ECDSA-K256"), ("brainpoolP256r1", "ECDSA-BRAINPOOL256"), ("brainpoolP384r1", "ECDSA-BRAINPOOL384"))
HASH_NAMES = (("sha256", "SHA-256"), ("sha384", "SHA-384"), ("sha512", "SHA-512"), ("sha1", "SHA-1"), ("sha224", "SHA-224"), ("md5", "MD5"))
PLAIN_KEYS = ("Ed25519", "Ed448", "X25519", "X448")
#: Languages of source files by extension.
LANGUAGES = ((".py", "python"), (".pyw", "python"), (".java", "java"), (".js", "javascript"), (".mjs", "javascript"), (".cjs", "javascript"), (".c", "c"), (".h", "c"), (".cpp", "c"), (".cc", "c"), (".cxx", "c"), (".hpp", "c"))
#: Decorators and names that make a function an entry point.
ROUTES = r"(?i)route$|^get$|^post$|^put$|^delete$|^patch$|endpoint$|handler$|webhook$|view$|^api_|^handle_|^on_|^dispatch|^process_request|^serve"
ENTRY_NAMES = ("main", "__main__", "run", "start", "execute", "handle", "handler", "process", "dispatch", "setUp", "setup", "tearDown", "teardown", "__call__")
FAMILIES = ("RSA", "ECDSA", "ECDH", "DSA", "DH", "AES", "HMAC", "ML-KEM", "ML-DSA", "SLH-DSA", "FALCON", "ED25519", "ED448", "X25519", "X448", "CHACHA20", "DES", "RC4", "MD5")

# (surfaces, purposes, upper-case algorithm prefixes, path parts, classification, result, description), in order of priority; None: any.
_INFRA_PATHS = ("tls", "ssl", "ssh", "pki", "cert", "network", "socket", "proxy", "gateway", "infra", "transport", "handshake")
CLASSIFICATION = (
    (("certificate",), None, None, None, None, "infrastructure", "certificate surface"),
    (("binary", "container"), None, None, None, None, "application", "binary and container"),
    (None, ("key_establishment",), None, _INFRA_PATHS, None, "infrastructure", "key establishment on a transport path"),
    (None, None, ("TLS-", "SSL-"), None, None, "infrastructure", "transport protocol"),
    (("source_code",), None, None, None, None, "application", "source code"),
)
SENSITIVITY = (
    (("certificate",), ("key_establishment",), None, None, None, "critical", "certificate key"),
    (("certificate",), ("digital_signature",), None, None, None, "critical", "certificate signature"),
    (None, None, ("DES", "3DES", "RC4"), None, None, "high", "broken cipher"),
    (None, None, ("MD5", "SHA-1"), None, None, "high", "broken hash"),
    (None, ("key_establishment",), None, None, None, "high", "key establishment"),
    (None, ("digital_signature",), None, None, None, "high", "signature"),
    (None, ("encryption",), None, None, None, "confidential", "encryption"),
    (("certificate",), None, None, None, None, "high", "certificate surface"),
    (None, ("mac", "key_derivation", "random_generation"), None, None, None, "internal", "mac, derivation, random"),
    (None, ("hashing",), ("SHA-256", "SHA-384", "SHA-512", "SHA-3", "SHA3-", "BLAKE"), None, None, "internal", "sound hash"),
    (None, ("unknown",), None, None, None, "internal", "unknown purpose"),
)
CRITICALITY = (
    (None, None, ("DES", "3DES", "RC4", "MD5", "SHA-1"), None, None, "critical", "broken algorithm"),
    (None, ("key_establishment",), None, None, "infrastructure", "critical", "infrastructure key establishment"),
    (("certificate",), None, None, None, None, "critical", "certificate surface"),
    (None, ("key_establishment",), None, None, "application", "critical", "application key establishment"),
    (None, ("digital_signature",), None, None, None, "high", "signature"),
    (None, ("encryption",), None, None, None, "medium", "encryption"),
    (None, ("hashing", "mac", "key_derivation", "random_generation"), None, None, None, "low", "hash, mac, derivation, random"),
)
FALLBACK = {"classification": "application", "sensitivity": "internal", "criticality": "low"}
ROTATION_DAYS = 90
LEGACY = ("TLS-1.0", "TLS-1.1", "TLS-LEGACY", "SSL-", "DES", "RC4", "MD5", "SHA-1")

# (pattern, purpose, vulnerable, broken, weakened, replacement, status, path type, path, alternative, protocols)
_KEM, _DSA, _GCM, _SHA = "ML-KEM (FIPS 203)", "ML-DSA (FIPS 204)", "AES-256-GCM (FIPS 197)", "SHA-256 (FIPS 180-4) or SHA3-256 (FIPS 202)"
MAPPINGS = (
    ("RSA", "key_establishment", True, False, False, _KEM, "standardized", "hybrid", "hybrid: X25519 + ML-KEM-768", "ML-KEM-1024 (FIPS 203)", ("TLS 1.2", "TLS 1.3", "PKCS#7", "CMS", "S/MIME")),
    ("RSA", "digital_signature", True, False, False, _DSA, "standardized", "hybrid", "hybrid: ECDSA-P256 + ML-DSA-65", "SLH-DSA (FIPS 205)", ("TLS 1.2", "TLS 1.3", "X.509", "JWT", "code signing")),
    ("RSA", "encryption", True, False, False, _KEM, "standardized", "hybrid", "hybrid: X25519 + ML-KEM-768", None, ("TLS 1.2", "PKCS#7", "S/MIME", "PGP")),
    ("ECDSA", "digital_signature", True, False, False, _DSA, "standardized", "hybrid", "hybrid: ECDSA-P256 + ML-DSA-44", "SLH-DSA (FIPS 205)", ("TLS 1.3", "X.509", "JWT", "DNSSEC", "code signing")),
    ("EC", "key_establishment", True, False, False, _KEM, "standardized", "hybrid", "hybrid: X25519 + ML-KEM-768", None, ("TLS 1.3", "Signal Protocol", "Noise Protocol")),
    ("DH", "key_establishment", True, False, False, _KEM, "standardized", "hybrid", "hybrid: X25519 + ML-KEM-768", None, ("TLS 1.2", "IKEv2", "SSH")),
    ("MD5", "hashing", True, True, False, _SHA, "standardized", "classical_upgrade", "replace: MD5 → SHA-256 or SHA3-256", None, ("TLS", "certificate fingerprinting", "file integrity")),
    ("SHA-1", "hashing", True, True, False, _SHA, "standardized", "classical_upgrade", "replace: SHA-1 → SHA-256 or SHA3-256", None, ("TLS", "X.509", "Git", "certificate fingerprinting")),
    ("DES", "encryption", True, True, False, _GCM, "standardized", "classical_upgrade", "replace: DES → AES-256-GCM", None, ("TLS (legacy)", "PKCS#5", "legacy VPN")),
    ("3DES", "encryption", True, True, False, _GCM, "standardized", "classical_upgrade", "replace: 3DES → AES-256-GCM", None, ("TLS (legacy)", "PKCS#5")),
    ("RC4", "encryption", True, True, False, _GCM, "standardized", "classical_upgrade", "replace: RC4 → AES-256-GCM", None, ("TLS (prohibited)", "WEP", "legacy protocols")),
    ("AES-128", "encryption", False, False, True, _GCM, "standardized", "classical_upgrade", "upgrade: AES-128 → AES-256 (Grover security margin)", None, None),
    ("AES", "encryption", False, False, True, _GCM, "standardized", "classical_upgrade", "upgrade: AES → AES-256-GCM (verify key size >= 256 bits)", None, None),
    ("TLS-1.0", "key_establishment", True, True, False, "TLS 1.3 with ML-KEM key exchange", "standardized", "hybrid", "upgrade: TLS 1.0/1.1 → TLS 1.3 with X25519+ML-KEM-768", None, ("HTTPS", "SMTP/TLS", "IMAP/TLS")),
    ("TLS-LEGACY", "key_establishment", True, True, False, "TLS 1.3 with ML-KEM key exchange", "standardized", "hybrid", "upgrade: deprecated TLS API → TLS 1.3 with X25519+ML-KEM-768", None, ("HTTPS", "SMTP/TLS")),
    ("DSA", "digital_signature", True, False, False, _DSA, "standardized", "hybrid", "hybrid: DSA + ML-DSA-65", "SLH-DSA (FIPS 205)", None),
    ("RSA", "unknown", True, False, False, "ML-KEM (FIPS 203) if key establishment; ML-DSA (FIPS 204) if signature — confirm operation", "standardized", "hybrid", "confirm RSA operation (encrypt vs sign), then follow the matching purpose mapping", "SLH-DSA (FIPS 205) for signatures", None),
    ("ECDSA", "unknown", True, False, False, "ML-DSA (FIPS 204) if signature; ML-KEM (FIPS 203) if key establishment — confirm operation", "standardized", "hybrid", "confirm EC operation (sign vs ECDH), then follow the matching purpose mapping", None, None),
    ("AES", "unknown", False, False, True, _GCM, "standardized", "classical_upgrade", "confirm AES mode/key size; upgrade short keys to AES-256-GCM", None, None),
    ("HMAC", "mac", False, False, False, "HMAC-SHA-256 or HMAC-SHA-384 (if not already)", "standardized", "no_action", "verify inner hash is SHA-256 or stronger; no migration needed", None, None),
    ("SHA-256", "hashing", False, False, False, "SHA-256 (retain) or SHA3-256 for new systems", "standardized", "no_action", "no migration required — SHA-256 provides 128-bit PQ security", None, None),
    ("SHA-512", "hashing", False, False, False, "SHA-512 (retain)", "standardized", "no_action", "no migration required — SHA-512 provides 256-bit PQ security", None, None),
    ("ML-KEM", "key_establishment", False, False, False, "ML-KEM (already PQC-native)", "standardized", "no_action", "no migration required — ML-KEM is NIST-standardized PQC", None, None),
    ("ML-DSA", "digital_signature", False, False, False, "ML-DSA (already PQC-native)", "standardized", "no_action", "no migration required — ML-DSA is NIST-standardized PQC", None, None),
    ("SLH-DSA", "digital_signature", False, False, False, "SLH-DSA (already PQC-native)", "standardized", "no_action", "no migration required — SLH-DSA is NIST-standardized PQC", None, None),
    ("FALCON", "digital_signature", False, False, False, "Falcon (FN-DSA track — monitor, do not deploy as primary)", "under_standardization", "no_action", "track FN-DSA finalization; prefer ML-DSA for new deployments", None, None),
)
UNDER_STANDARDIZATION = ("HQC", "Falcon", "BIKE")
SHELF_LIFE = (
    ("infrastructure", "internal", 1), ("infrastructure", "confidential", 3), ("infrastructure", "high", 5), ("infrastructure", "critical", 10),
    ("application", "public", 1), ("application", "internal", 3), ("application", "confidential", 7), ("application", "high", 15), ("application", "critical", 20),
)
MIGRATION_YEARS = (
    ("RSA", "key_establishment", 2), ("RSA", "digital_signature", 3), ("ECDSA", "digital_signature", 3), ("EC", "key_establishment", 2), ("DH", "key_establishment", 2),
    ("MD5", "hashing", 1), ("SHA-1", "hashing", 1), ("DES", "encryption", 1), ("3DES", "encryption", 1), ("RC4", "encryption", 1), ("AES-128", "encryption", 1), ("TLS", "key_establishment", 2),
)
Y_DEFAULT, Z_DEFAULT = 2, 10
Z_SCENARIOS = (("conservative", 10), ("moderate", 15), ("optimistic", 20))
HNDL_YEARS, HNDL_SIGNATURE_YEARS = 3, 5

FACTORS = ("bandwidth", "storage", "latency", "protocol", "application_software", "hardware_hsm", "vendor_dependency", "cost")
WEIGHTS = (0.10, 0.10, 0.10, 0.20, 0.20, 0.15, 0.10, 0.05)
# (prefix, purpose or None, scores in the order of FACTORS)
IMPACTS = (
    ("RSA", "key_establishment", (0.7, 0.5, 0.3, 0.8, 0.7, 0.6, 0.7, 0.7)),
    ("RSA", "digital_signature", (0.8, 0.7, 0.5, 0.8, 0.7, 0.6, 0.7, 0.7)),
    ("ECDSA", "digital_signature", (0.8, 0.8, 0.5, 0.8, 0.7, 0.6, 0.6, 0.6)),
    ("MD5", None, (0.1, 0.1, 0.1, 0.3, 0.4, 0.1, 0.2, 0.2)),
    ("SHA-1", None, (0.2, 0.2, 0.1, 0.5, 0.4, 0.1, 0.3, 0.3)),
    ("DES", None, (0.2, 0.2, 0.1, 0.5, 0.5, 0.4, 0.4, 0.4)),
    ("3DES", None, (0.2, 0.2, 0.1, 0.5, 0.5, 0.4, 0.4, 0.4)),
    ("AES", None, (0.1, 0.1, 0.1, 0.2, 0.3, 0.3, 0.2, 0.2)),
    ("TLS", None, (0.6, 0.3, 0.5, 0.9, 0.6, 0.4, 0.8, 0.8)),
    ("HMAC", None, (0.0,) * 8),
    ("SHA-256", None, (0.0,) * 8),
    ("SHA-512", None, (0.0,) * 8),
    ("", None, (0.4, 0.3, 0.3, 0.5, 0.5, 0.3, 0.4, 0.4)),
)
# Validation steps by kind of path; another kind takes those of the first.
STEPS = (
    (
        "hybrid",
        (
            "Deploy hybrid mode (classical + PQC) alongside existing deployment",
            "Run interoperability test suite against all known clients",
            "Verify TLS/protocol handshake succeeds with hybrid key exchange",
            "Monitor error rates for negotiation failures (14-day observation)",
            "Confirm HSM/key-store supports new key material size",
            "Retire classical-only configuration after hybrid validation period",
            "Update certificate chain and CAB Forum compliance documentation",
        ),
    ),
    (
        "pure_pqc",
        (
            "Verify all clients and peers support the target PQC algorithm",
            "Run PQC-only interoperability test suite",
            "Confirm no classical fallback path exists in production",
            "Validate HSM firmware supports PQC key operations",
            "Document quantum-safe configuration for compliance records",
        ),
    ),
    (
        "classical_upgrade",
        (
            "Replace deprecated algorithm with approved replacement in code",
            "Update test suite to validate new algorithm output",
            "Verify downstream systems accept new algorithm output format",
            "Run regression tests to confirm functional equivalence",
            "Update security documentation and compliance attestation",
        ),
    ),
    (
        "no_action",
        (
            "Confirm current algorithm meets security requirements for intended lifetime",
            "Schedule re-evaluation if data sensitivity or retention period changes",
        ),
    ),
)
#: Texts of recommendations without a mapping.
UNKNOWN_REPLACEMENT, UNKNOWN_PATH = "UNKNOWN — see the replacement mappings", "manual review required"

# (rule, pattern, algorithm, purpose, confidence)
FINGERPRINTS = (
    ("B-001", r"libcrypto\.so|libcrypto-[0-9]|LIBCRYPTO", "OpenSSL-libcrypto", "encryption", 0.80),
    ("B-002", r"OpenSSL [0-9]+\.[0-9]+\.[0-9]+[a-z]?", "OpenSSL-version", "encryption", 0.75),
    ("B-010", "RSA_generate_key|RSA_new|RSA_private_(encrypt|decrypt)|RSA_public_(encrypt|decrypt)|rsa_generate", "RSA", "key_establishment", 0.90),
    ("B-011", "RSA_sign|RSA_verify|RSA_padding|rsa_(sign|verify)", "RSA", "digital_signature", 0.90),
    ("B-020", "EC_KEY_new|EC_KEY_generate_key|ECDH_compute_key|ECDSA_sign|ECDSA_verify|ecdsa|ecdh", "ECDSA", "digital_signature", 0.88),
    ("B-030", "AES_(encrypt|decrypt|set_encrypt_key|set_decrypt_key)|EVP_aes_[0-9]+|aes_[0-9]+_[a-z]+", "AES", "encryption", 0.88),
    ("B-031", "DES_(encrypt|decrypt|set_key)|EVP_des_ede3|des_ede", "DES", "encryption", 0.88),
    ("B-032", "ChaCha20|chacha20_poly1305|EVP_chacha20|Poly1305", "ChaCha20-Poly1305", "encryption", 0.85),
    ("B-040", "SHA256_Init|SHA256_Update|SHA512_Init|SHA512_Update|EVP_sha(256|384|512)", "SHA-256", "hashing", 0.88),
    ("B-041", "MD5_Init|MD5_Update|EVP_md5", "MD5", "hashing", 0.90),
    ("B-042", "SHA1_Init|SHA1_Update|EVP_sha1", "SHA-1", "hashing", 0.90),
    ("B-050", "HMAC_Init|HMAC_Update|HMAC_CTX", "HMAC", "mac", 0.88),
    ("B-051", "PKCS5_PBKDF2|HKDF|EVP_PBE|PBKDF2", "PBKDF2", "key_derivation", 0.85),
    ("B-060", "SSL_CTX_new|SSL_connect|SSL_accept|TLS_method|TLS_client_method|TLS_server_method", "TLS-1.2", "key_establishment", 0.85),
    ("B-070", "BCrypt(GenerateSymmetricKey|Encrypt|Decrypt|SignHash|VerifySignature)", "AES", "encryption", 0.80),
    ("B-071", "CryptAcquireContext|CryptEncrypt|CryptDecrypt|CryptSignHash|CryptVerifySignature", "RSA", "key_establishment", 0.80),
)
CONTAINER = (
    ("T-001", "openssl|libssl|libcrypto", "OpenSSL-libcrypto", "encryption", 0.78),
    ("T-002", r"\bcryptography\b|pycryptodome|pycrypto|pyopenssl", "OpenSSL-libcrypto", "encryption", 0.78),
    ("T-003", r"\bnode-forge\b|\bsjcl\b|\bcryptokit\b|\blibsodium-wrappers\b", "AES", "encryption", 0.72),
    ("T-004", "bouncy-?castle|bcprov|bcpkix", "RSA", "key_establishment", 0.74),
    ("T-005", r"golang\.org/x/crypto|github\.com/.*(tls|crypto)", "TLS-1.2", "key_establishment", 0.72),
    ("T-006", r"\brustls\b|\bring\b|\brsa\b|\bed25519-dalek\b|\baes-gcm\b", "AES", "encryption", 0.72),
    ("T-007", r"\bmd5sum\b|\bsha1sum\b", "MD5", "hashing", 0.70),
)
# The first match in this order wins.
INFRA = (
    ("I-001", "TLS_AES_|TLS_CHACHA20|TLS_AES_128_GCM|TLS_AES_256_GCM", "AES-256-GCM", "encryption", 0.90),
    ("I-002", "ECDHE|ECDH", "ECDSA-P256", "key_establishment", 0.88),
    ("I-003", "(?<!EC)DHE|DH_anon|DH-DSS", "DH-2048", "key_establishment", 0.86),
    ("I-004", r"\bRSA\b|AES.*SHA|CAMELLIA|SEED", "RSA-2048", "key_establishment", 0.84),
    ("I-005", "RC4|DES|3DES|MD5|EXPORT|NULL|anon", "RC4", "encryption", 0.90),
)
MANIFESTS = ("requirements.txt", "requirements.lock", "package.json", "package-lock.json", "go.mod", "cargo.toml", "cargo.lock", "pom.xml", "build.gradle", "dockerfile", "containerfile")
# (name, pattern); applied in this order, case ignored.
INJECTIONS = (
    ("ignore_instructions", r"ignore\s+(previous|prior|above|all|your)\s+(instructions?|prompts?|context|rules?)"),
    ("forget_instructions", r"forget\s+(everything|all|previous|prior|your)\s*(instructions?|context|rules?)?"),
    ("new_instructions", r"new\s+instructions?\s*[:=]"),
    ("you_are_now", r"you\s+are\s+now\s+(a|an|the)\s+\w+"),
    ("act_as", r"act\s+as\s+(a|an|the)\s+\w+"),
    ("pretend_to_be", r"pretend\s+to\s+be\s+(a|an|the)\s+\w+"),
    ("from_now_on", r"from\s+now\s+on[,\s]+(you\s+(are|will)|your\s+role)"),
    ("llama_inst_tag", r"\[/?INST\]"),
    ("system_tag", r"<\|?(system|user|assistant|im_start|im_end)\|?>"),
    ("triple_dash_separator", r"(?m)^---+\s*$"),
    ("triple_hash_separator", r"(?m)^###\s*(SYSTEM|HUMAN|ASSISTANT|INSTRUCTION|CONTEXT)\s*$"),
    ("system_prompt_override", r"system\s+prompt\s*[:=]"),
    ("override_prompt", r"(override|replace|change|update)\s+(the\s+)?(system\s+)?prompt"),
    ("jailbreak_dan", r"\bDAN\b.*?(mode|enabled?|activated?)"),
    ("disregard_rules", r"disregard\s+(your\s+)?(rules?|guidelines?|safety|constraints?|policies?)"),
)


def mapping_table(spark: SparkSession) -> DataFrame:
    """The replacement mappings with their order; 26 rows, so joins may broadcast it."""
    schema = "ord int, pattern string, map_purpose string, vulnerable boolean, broken boolean, weakened boolean, replacement string, status string, path_type string, path string, alternative string, protocols array<string>"
    return spark.createDataFrame([(i, *m[:10], list(m[10]) if m[10] else None) for i, m in enumerate(MAPPINGS)], schema)


def fingerprint_table(spark: SparkSession, rules: tuple = FINGERPRINTS) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "ord int, rule_id string, pattern string, algorithm string, purpose string, confidence double")


def rule_violations(rules: DataFrame) -> DataFrame:
    """(rule_id, problem) of a rule table: repeated id, missing field, confidence out of range, unknown purpose. Empty for a sound table."""
    from pyspark.sql import functions as F

    twice = rules.groupBy("rule_id").count().filter("count > 1").select("rule_id", F.lit("duplicate id").alias("problem"))
    bad = F.array_compact(
        F.array(
            F.when(F.col("rule_id").isNull() | F.col("pattern").isNull() | F.col("algorithm").isNull(), F.lit("missing field")),
            F.when(~F.col("confidence").between(0, 1) | F.col("confidence").isNull(), F.lit("confidence out of range")),
            F.when(~F.col("purpose").isin(*PURPOSES) | F.col("purpose").isNull(), F.lit("unknown purpose")),
        )
    )
    return twice.union(rules.select("rule_id", F.explode(bad)))
