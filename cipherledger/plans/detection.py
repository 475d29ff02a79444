"""Call and symbol rules for source code. Names, values and scores must be these for right results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# (rule, language, kind, module or None, function or symbol, algorithm, purpose, confidence); a final * marks a prefix.
RULES = (
    ("R-001", "python", "call_chain", "RSA", "generate", "RSA", "key_establishment", 0.97),
    ("R-012", "python", "call_chain", "rsa", "generate_private_key", "RSA", "key_establishment", 0.97),
    ("R-002", "python", "call_chain", "MD5", "new", "MD5", "hashing", 0.97),
    ("R-007", "python", "call_chain", "hashlib", "md5", "MD5", "hashing", 0.97),
    ("R-021", "python", "call_with_arg", "hashlib", "new", "MD5", "hashing", 0.92),
    ("R-003", "python", "call_chain", "SHA1", "new", "SHA-1", "hashing", 0.97),
    ("R-017", "python", "call_chain", "hashlib", "sha1", "SHA-1", "hashing", 0.97),
    ("R-022", "python", "call_with_arg", "hashlib", "new", "SHA-1", "hashing", 0.92),
    ("R-008", "python", "call_chain", "hashlib", "sha256", "SHA-256", "hashing", 0.97),
    ("R-014", "python", "call_chain", "hashlib", "sha512", "SHA-512", "hashing", 0.97),
    ("R-004", "python", "call_chain", "DES", "new", "DES", "encryption", 0.98),
    ("R-005", "python", "call_chain", "AES", "new", "AES", "encryption", 0.95),
    ("R-010", "python", "call_chain", "Fernet", "generate_key", "AES-128-CBC", "encryption", 0.93),
    ("R-011", "python", "call_chain", "ec", "generate_private_key", "ECDSA", "digital_signature", 0.97),
    ("R-013", "python", "call_chain", "hmac", "new", "HMAC", "mac", 0.95),
    ("R-023", "python", "call_chain", "hmac", "digest", "HMAC", "mac", 0.95),
    ("R-009", "python", "call_chain", "ssl", "SSLContext", "TLS-1.0", "key_establishment", 0.90),
    ("R-016", "python", "call_chain", "ssl", "wrap_socket", "TLS-legacy", "key_establishment", 0.93),
    ("R-101", "java", "call_with_arg", None, "getInstance", "MD5", "hashing", 0.97),
    ("R-102", "java", "call_with_arg", None, "getInstance", "SHA-1", "hashing", 0.97),
    ("R-103", "java", "call_with_arg", None, "getInstance", "RSA", "key_establishment", 0.96),
    ("R-201", "javascript", "call_with_arg", None, "createHash", "MD5", "hashing", 0.97),
    ("R-202", "javascript", "call_with_arg", None, "createHash", "SHA-1", "hashing", 0.97),
    ("R-203", "javascript", "call_with_arg", None, "generateKeyPair", "RSA", "key_establishment", 0.96),
    ("R-301", "c", "call_chain", None, "RSA_generate_key", "RSA", "key_establishment", 0.97),
    ("R-330", "c", "call_chain", None, "RSA_generate_key_ex", "RSA", "key_establishment", 0.97),
    ("R-331", "c", "call_chain", None, "RSA_new", "RSA", "unknown", 0.75),
    ("R-332", "c", "call_chain", None, "RSA_public_encrypt", "RSA", "key_establishment", 0.95),
    ("R-333", "c", "call_chain", None, "RSA_private_decrypt", "RSA", "key_establishment", 0.95),
    ("R-334", "c", "call_chain", None, "RSA_sign", "RSA", "digital_signature", 0.95),
    ("R-335", "c", "call_chain", None, "RSA_verify", "RSA", "digital_signature", 0.95),
    ("R-336", "c", "call_chain", None, "RSA_generate_multi_prime_key", "RSA", "key_establishment", 0.95),
    ("R-340", "c", "call_chain", None, "EC_KEY_new", "ECDSA", "unknown", 0.72),
    ("R-341", "c", "call_chain", None, "EC_KEY_new_by_curve_name", "ECDSA", "unknown", 0.85),
    ("R-342", "c", "call_chain", None, "EC_KEY_generate_key", "ECDSA", "key_establishment", 0.94),
    ("R-343", "c", "call_chain", None, "ECDSA_sign", "ECDSA", "digital_signature", 0.95),
    ("R-344", "c", "call_chain", None, "ECDSA_verify", "ECDSA", "digital_signature", 0.95),
    ("R-345", "c", "call_chain", None, "ECDH_compute_key", "ECDH", "key_establishment", 0.95),
    ("R-350", "c", "c_symbol", None, "EVP_PKEY_RSA", "RSA", "unknown", 0.80),
    ("R-351", "c", "c_symbol", None, "EVP_PKEY_EC", "ECDSA", "unknown", 0.80),
    ("R-352", "c", "c_symbol", None, "EVP_PKEY_ED25519", "Ed25519", "digital_signature", 0.90),
    ("R-353", "c", "c_symbol", None, "EVP_PKEY_ED448", "Ed448", "digital_signature", 0.90),
    ("R-354", "c", "call_chain", None, "EVP_PKEY_CTX_set_rsa_keygen_bits", "RSA", "key_establishment", 0.88),
    ("R-355", "c", "call_chain", None, "EVP_PKEY_CTX_set_rsa_padding", "RSA", "unknown", 0.78),
    ("R-356", "c", "call_chain", None, "EVP_PKEY_CTX_set_ec_paramgen_curve_nid", "ECDSA", "unknown", 0.82),
    ("R-360", "c", "call_chain", None, "EVP_aes_128_gcm", "AES-128-GCM", "encryption", 0.97),
    ("R-361", "c", "call_chain", None, "EVP_aes_192_gcm", "AES-192-GCM", "encryption", 0.97),
    ("R-362", "c", "call_chain", None, "EVP_aes_256_gcm", "AES-256-GCM", "encryption", 0.97),
    ("R-363", "c", "call_chain", None, "EVP_aes_128_cbc", "AES-128-CBC", "encryption", 0.97),
    ("R-364", "c", "call_chain", None, "EVP_aes_256_cbc", "AES-256-CBC", "encryption", 0.97),
    ("R-365", "c", "call_chain", None, "EVP_EncryptInit_ex", "AES", "encryption", 0.88),
    ("R-366", "c", "call_chain", None, "EVP_DecryptInit_ex", "AES", "encryption", 0.88),
    ("R-367", "c", "call_chain", None, "EVP_CipherInit_ex", "AES", "unknown", 0.80),
    ("R-370", "c", "call_chain", None, "EVP_sha1", "SHA-1", "hashing", 0.97),
    ("R-371", "c", "call_chain", None, "EVP_sha224", "SHA-224", "hashing", 0.97),
    ("R-372", "c", "call_chain", None, "EVP_sha256", "SHA-256", "hashing", 0.97),
    ("R-373", "c", "call_chain", None, "EVP_sha384", "SHA-384", "hashing", 0.97),
    ("R-374", "c", "call_chain", None, "EVP_sha512", "SHA-512", "hashing", 0.97),
    ("R-375", "c", "call_chain", None, "EVP_md5", "MD5", "hashing", 0.97),
    ("R-376", "c", "call_chain", None, "EVP_sha3_256", "SHA3-256", "hashing", 0.97),
    ("R-377", "c", "call_chain", None, "EVP_sha3_384", "SHA3-384", "hashing", 0.97),
    ("R-378", "c", "call_chain", None, "EVP_sha3_512", "SHA3-512", "hashing", 0.97),
    ("R-379", "c", "call_chain", None, "SHA1_Init", "SHA-1", "hashing", 0.95),
    ("R-380", "c", "call_chain", None, "SHA256_Init", "SHA-256", "hashing", 0.95),
    ("R-385", "c", "call_chain", None, "HMAC", "HMAC", "mac", 0.94),
    ("R-386", "c", "call_chain", None, "HMAC_Init_ex", "HMAC", "mac", 0.94),
    ("R-387", "c", "call_chain", None, "EVP_MAC_init", "HMAC", "mac", 0.88),
    ("R-388", "c", "call_chain", None, "EVP_MAC_update", "HMAC", "mac", 0.88),
    ("R-389", "c", "call_chain", None, "EVP_MAC_final", "HMAC", "mac", 0.88),
    ("R-390", "c", "call_chain", None, "DSA_new", "DSA", "unknown", 0.75),
    ("R-391", "c", "call_chain", None, "DSA_generate_key", "DSA", "digital_signature", 0.90),
    ("R-392", "c", "call_chain", None, "DSA_sign", "DSA", "digital_signature", 0.95),
    ("R-393", "c", "call_chain", None, "DSA_verify", "DSA", "digital_signature", 0.95),
    ("R-394", "c", "call_chain", None, "DH_new", "DH", "unknown", 0.75),
    ("R-395", "c", "call_chain", None, "DH_generate_key", "DH", "key_establishment", 0.93),
    ("R-396", "c", "call_chain", None, "DH_compute_key", "DH", "key_establishment", 0.95),
    ("R-397", "c", "c_symbol", None, "NID_rsaEncryption", "RSA", "unknown", 0.82),
    ("R-398", "c", "c_symbol", None, "NID_X9_62_id_ecPublicKey", "ECDSA", "unknown", 0.82),
    ("R-399", "c", "c_symbol", None, "NID_ED25519", "Ed25519", "digital_signature", 0.88),
    ("R-400", "c", "c_symbol", None, "NID_X25519", "X25519", "key_establishment", 0.88),
    ("R-401", "c", "c_symbol", None, "NID_sha256", "SHA-256", "hashing", 0.88),
    ("R-402", "c", "c_symbol", None, "NID_aes_256_gcm", "AES-256-GCM", "encryption", 0.90),
    ("R-403", "c", "c_symbol", None, "NID_X9_62_prime256v1", "ECDSA", "unknown", 0.84),
    ("R-404", "c", "c_symbol", None, "NID_secp384r1", "ECDSA", "unknown", 0.84),
    ("R-405", "c", "c_symbol", None, "NID_secp521r1", "ECDSA", "unknown", 0.84),
    ("R-406", "c", "c_symbol", None, "NID_X448", "X448", "key_establishment", 0.88),
    ("R-302", "c", "call_chain", None, "MD5", "MD5", "hashing", 0.97),
    ("R-303", "c", "call_chain", None, "SHA1", "SHA-1", "hashing", 0.97),
    ("R-304", "c", "call_with_arg", None, "EVP_get_digestbyname", "EVP-digest", "hashing", 0.85),
    ("R-310", "c", "call_chain", None, "OQS_KEM_new", "ML-KEM", "key_establishment", 0.95),
    ("R-311", "c", "call_chain", None, "OQS_KEM_keypair", "ML-KEM", "key_establishment", 0.95),
    ("R-312", "c", "call_chain", None, "OQS_KEM_encaps", "ML-KEM", "key_establishment", 0.95),
    ("R-313", "c", "call_chain", None, "OQS_KEM_decaps", "ML-KEM", "key_establishment", 0.95),
    ("R-314", "c", "call_chain", None, "OQS_SIG_new", "ML-DSA", "digital_signature", 0.95),
    ("R-315", "c", "call_chain", None, "OQS_SIG_keypair", "ML-DSA", "digital_signature", 0.95),
    ("R-316", "c", "call_chain", None, "OQS_SIG_sign", "ML-DSA", "digital_signature", 0.95),
    ("R-317", "c", "call_chain", None, "OQS_SIG_verify", "ML-DSA", "digital_signature", 0.95),
    ("R-318", "c", "call_chain", None, "OQS_KEM_ml_kem_*", "ML-KEM", "key_establishment", 0.96),
    ("R-319", "c", "call_chain", None, "OQS_SIG_ml_dsa_*", "ML-DSA", "digital_signature", 0.96),
    ("R-320", "c", "call_chain", None, "OQS_SIG_slh_dsa_*", "SLH-DSA", "digital_signature", 0.96),
    ("R-321", "c", "call_chain", None, "OQS_SIG_falcon_*", "Falcon", "digital_signature", 0.93),
)
#: Values of the first argument of the rules of kind call_with_arg.
VALUES = {
    "R-021": ("md5", "MD5"),
    "R-022": ("sha1", "SHA1", "sha-1", "SHA-1"),
    "R-101": ("MD5", "md5"),
    "R-102": ("SHA-1", "SHA1", "sha-1", "sha1"),
    "R-103": ("RSA", "rsa"),
    "R-201": ("md5", "MD5"),
    "R-202": ("sha1", "sha-1", "SHA1", "SHA-1"),
    "R-203": ("rsa", "RSA"),
    "R-304": ("md5", "MD5", "sha1", "SHA1", "sha-1", "SHA-1"),
}
#: Roles of symbols that aren't `any`, sizes in bits of a rule itself, and where a call states its size.
ROLES = dict.fromkeys(("R-397", "R-398", "R-399", "R-400", "R-401", "R-402", "R-403", "R-404", "R-405", "R-406"), "constant")
SIZES = {"R-004": 56, "R-010": 128}
SIZE_ARGUMENTS = {"R-001": 0, "R-301": 0}
SIZE_KEYWORDS = {"R-012": "key_size"}
KINDS = ("call_chain", "call_with_arg", "c_symbol")
#: Spellings of curves, and the functions whose first argument names one.
CURVES = (
    ("P256", ("PRIME256V1", "PRIME256", "SECP256R1", "P-256", "P256")),
    ("P384", ("SECP384R1", "P-384", "P384")),
    ("P521", ("SECP521R1", "P-521", "P521")),
    ("K256", ("SECP256K1", "P256K1")),
)
CURVE_CLASSES = ("SECP256R1", "SECP384R1", "SECP521R1", "SECP256K1", "BRAINPOOLP256R1")
CURVE_FUNCTIONS = ("EC_KEY_new_by_curve_name", "EVP_PKEY_CTX_set_ec_paramgen_curve_nid")

SCHEMA = "ord int, rule_id string, language string, kind string, rule_module string, rule_function string, algorithm string, purpose string, confidence double, arg_values array<string>, role string, rule_size int, size_argument int, size_keyword string"


def detection_table(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    """The rules with their order, as a table of fixed size that joins may broadcast."""
    more = lambda r: (list(VALUES[r]) if r in VALUES else None, ROLES.get(r, "any"), SIZES.get(r), SIZE_ARGUMENTS.get(r), SIZE_KEYWORDS.get(r))
    return spark.createDataFrame([(i, *r, *more(r[0])) for i, r in enumerate(rules)], SCHEMA)
