"""Text functions as Spark expressions: pre-tokenizers, the byte-level alphabet and piece clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two public pre-tokenization patterns. (?U) makes \s and the classes follow Unicode.
SPLIT = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}\p{M}]+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT_LETTERS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Byte-level forms of space, line feed and tab.
BLANKS = "ĠĊĉ"


def byte_alphabet() -> dict[int, str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the others for U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_MOVED = {b: c for b, c in sorted(byte_alphabet().items()) if ord(c) != b}
_RAW, _SHOWN = "".join(map(chr, _MOVED)), "".join(_MOVED.values())


def unescape(text: Column, strict: bool = True) -> Column:
    r"""Two-character \t and \n to TAB and LF; then \_ to a backslash (strict), or to an underscore."""
    out = F.replace(F.replace(text, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n"))
    return F.replace(out, F.lit("\\_"), F.lit("\\" if strict else "_"))


def strip(text: Column) -> Column:
    """Without NUL, and without white space at both ends."""
    return F.regexp_replace(F.replace(text, F.lit("\x00"), F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def pretokens(text: Column, letters_only: bool = False) -> Column:
    """Pre-tokens by the regular pattern; gaps can't arise as the pattern covers all text."""
    return F.regexp_extract_all(text, F.lit(SPLIT_LETTERS if letters_only else SPLIT), F.lit(0))


def whitespace_pretokens(text: Column) -> Column:
    """Cut before white space that follows a non-space: white space leads a token, or is the last one."""
    return F.regexp_extract_all(text, F.lit(r"(?U)[\s\x1c-\x1f]*[^\s\x1c-\x1f]+|[\s\x1c-\x1f]+"), F.lit(0))


def to_byte_level(text: Column) -> Column:
    """Each UTF-8 byte as its printable character."""
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), _RAW, _SHOWN)


def from_byte_level(piece: Column) -> Column:
    """The inverse; text without NUL comes back unchanged."""
    return F.decode(F.encode(F.translate(piece, _SHOWN, _RAW), "ISO-8859-1"), "UTF-8")


def crop(text: Column, block_size: int, key: Column | None = None, chars_per_token: int = 16) -> Column:
    """A window of block_size x chars_per_token characters: from the start, or from a start that a hash of key gives."""
    size = block_size * chars_per_token
    if key is None:
        return F.substring(text, 1, size)
    start = F.pmod(F.xxhash64(key), F.greatest(F.length(text) - size, F.lit(0)) + 1)
    return F.substring(text, (start + 1).cast("int"), F.lit(size))


def clean_marker(piece: Column, space_marker: str = "▁", continuation: str | None = None) -> Column:
    """A piece of another vocabulary in byte-level form: the space marker becomes a space; a continuation prefix goes,
    and a piece without it gets a space in front."""
    out = F.replace(piece, F.lit(space_marker), F.lit(" "))
    if continuation:
        out = F.when(out.startswith(continuation), F.substring(out, F.lit(len(continuation) + 1), F.length(out))).otherwise(F.concat(F.lit(" "), out))
    return to_byte_level(out)


def byte_fallback(piece: Column) -> Column:
    """The byte-level character of a piece like <0x41>, up to <0xFE>; null for other pieces."""
    value = F.conv(F.regexp_extract(piece, r"^<0x([0-9A-F]{2})>$", 1), 16, 10).cast("int")
    table = F.array(*[F.lit(c) for _, c in sorted(byte_alphabet().items())])
    return F.when(piece.rlike(r"^<0x[0-9A-F]{2}>$") & (value < 255), F.element_at(table, value + 1))


def blank_run(piece: Column) -> Column:
    """Whether a byte-level piece has more than one blank."""
    return F.length(F.regexp_replace(piece, f"[^{BLANKS}]", "")) > 1


def placeholder(piece: Column, number: Column) -> Column:
    return F.when(blank_run(piece), F.concat(F.lit("<unused_whitespace__"), number.cast("string"), F.lit(">"))).otherwise(piece)


def path_name(path: Column) -> Column:
    """The last part of a path without its extension, slashes as underscores."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"^.*/(?=[^/]+$)", ""), r"\.[^./]*$", ""), F.lit("/"), F.lit("_"))


def surface_text(ids: Column, end_of_text: str = "<|endoftext|>") -> Column:
    """Byte-level ids back to text: 0 is padding; a piece that is the end-of-text marker is left out (null)."""
    table = F.array(*[F.lit(c) for _, c in sorted(byte_alphabet().items())])
    text = F.array_join(F.transform(F.filter(ids, lambda x: x != 0), lambda x: F.element_at(table, x + 1)), "")
    return F.when(text != end_of_text, text)
