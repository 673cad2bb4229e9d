"""Scalar expressions on names, paths and scores. All are built-in functions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in a name or signature that make a change a matter of security.
SECURITY_WORDS = (
    "auth", "login", "logout", "password", "passwd", "secret", "token", "jwt", "oauth", "crypto", "encrypt", "decrypt", "hash", "sign",
    "verify", "exec", "eval", "sql", "query", "sanitize", "escape", "admin", "permission", "cookie", "session", "csrf", "cors",
)
# Directories and file name parts of tests.
TEST_DIRS = ("tests", "test", "__tests__", "spec", "__mocks__")
TEST_PARTS = ("_test.", ".test.", ".spec.", ".bench.")
TEST_START = "test_"
TEST_PATH = "(^|/)(" + "|".join(TEST_DIRS) + ")/|" + "|".join(p.replace(".", "[.]") for p in TEST_PARTS) + f"|(^|/){TEST_START}"
# The cap on a doc comment, and the words that a name's vector is made of.
DOC_CHARS = 400
DIMENSIONS = 256


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def round2(c: Column) -> Column:
    """Two decimals, halves away from zero, by way of hundredths so that engines agree."""
    return F.round(c * 100) / 100


def is_test_path(path: Column) -> Column:
    return ascii_lower(path).rlike(TEST_PATH)


def is_security(name: Column, signature: Column) -> Column:
    """1.0 if a name or signature contains one of the security words, 0.0 otherwise."""
    text = F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(signature, F.lit(""))))
    return F.when(text.rlike("|".join(SECURITY_WORDS)), 1.0).otherwise(0.0)


def last_segment(module: Column) -> Column:
    """The last part of a module path or qualifier, over dots, slashes and colons; null if there is none."""
    return F.try_element_at(F.filter(F.split(module, "[./:]"), lambda x: x != ""), F.lit(-1))


def file_stem(path: Column) -> Column:
    """The file's name without its last extension; a leading dot doesn't begin one."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def parent_dir(path: Column) -> Column:
    """The name of the file's directory, null at the top."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def module_keys(path: Column) -> Column:
    """The module names by which a file can be meant."""
    return F.array_distinct(F.filter(F.array(file_stem(path), parent_dir(path)), lambda x: x.isNotNull() & (x != "")))


def module_matches(module: Column, path: Column) -> Column:
    return F.coalesce(F.array_contains(module_keys(path), last_segment(module)), F.lit(False))


def namespaced(repo: Column, name: Column) -> Column:
    return F.concat_ws("/", repo, name)


def module_of(path: Column) -> Column:
    """The top directory of a path, or (root)."""
    return F.when(F.instr(path, "/") > 0, F.split(path, "/")[0]).otherwise("(root)")


def short_label(qualified_name: Column) -> Column:
    """What follows the last double colon."""
    return F.substring_index(qualified_name, "::", -1)


def token_estimate(text: Column) -> Column:
    """Bytes over four: the estimate for a text when no tokenizer vocabulary is at hand."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def words(text: Column) -> Column:
    """Lower-case words of identifiers and prose: runs of letters and digits, split where a capital follows a small letter."""
    spaced = F.regexp_replace(text, r"(?<=\p{Ll})(?=\p{Lu})", " ")
    return F.filter(F.split(ascii_lower(spaced), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trigrams(word: Column) -> Column:
    """Three-letter pieces of ^word$."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))


def bucket(feature: Column) -> Column:
    """The low 8 bits of the 64-bit FNV-1a hash of a feature: each byte needs the low 8 bits alone."""
    # The low bytes of the offset basis (0x25) and of the prime (0xb3).
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(feature)), lambda i: F.conv(F.substring(F.hex(feature), i * 2 - 1, F.lit(2)), 16, 10).cast("int"))
    return F.when(F.length(feature) == 0, F.lit(0x25)).otherwise(F.aggregate(codes, F.lit(0x25), lambda h, b: (h.bitwiseXOR(b) * 0xB3).bitwiseAND(255)))


def features(text: Column) -> Column:
    """A text's features, with repeats: its words and their trigrams."""
    w = words(text)
    return F.concat(w, F.flatten(F.transform(w, trigrams)))
