from pyspark.sql import functions as F

from glyphmill.functions import text as T


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def test_unescape(spark):
    assert one(spark, "a\\tb\\nc\\_d", T.unescape) == "a\tb\nc\\d"
    assert one(spark, "c\\_d", lambda c: T.unescape(c, strict=False)) == "c_d"


def test_pretokenizers(spark):
    assert one(spark, "a  b ", T.whitespace_pretokens) == ["a", "  b", " "]
    text = "It's 3  é!\n\nok "
    assert one(spark, text, T.pretokens) == ["It", "'s", " 3", " ", " é", "!", "\n", "\n", "ok", " "]
    assert one(spark, text, lambda c: T.pretokens(c, letters_only=True)) == ["It", "'s", " 3", " ", " e", "́!", "\n", "\n", "ok", " "]
    for value in ("", "x   y", "　a　　", "\x1cx"):
        assert "".join(one(spark, value, T.pretokens)) == value
        assert "".join(one(spark, value, T.whitespace_pretokens)) == value


def test_byte_level(spark):
    assert one(spark, " naïve", T.to_byte_level) == "ĠnaÃ¯ve"
    for value in ("", "a\nb\tc", "日本語 \U0001f600", " é"):
        assert one(spark, value, lambda c: T.from_byte_level(T.to_byte_level(c))) == value
    table = T.byte_alphabet()
    assert len(set(table.values())) == 256 and sum(ord(c) == b for b, c in table.items()) == 188


def test_strip_and_crop(spark):
    assert one(spark, "\x00 \t a b \n", T.strip) == "a b"
    assert one(spark, "abc" * 20, lambda c: T.crop(c, 1)) == ("abc" * 20)[:16]
    cut = one(spark, "abc" * 200, lambda c: T.crop(c, 1, F.lit(7)))
    assert len(cut) == 16 and cut in "abc" * 200
    assert one(spark, "short", lambda c: T.crop(c, 4, F.lit(7))) == "short"


def test_pieces(spark):
    assert one(spark, "▁the", T.clean_marker) == "Ġthe"
    assert one(spark, "##ing", lambda c: T.clean_marker(c, continuation="##")) == "ing"
    assert one(spark, "the", lambda c: T.clean_marker(c, continuation="##")) == "Ġthe"
    assert [one(spark, x, T.byte_fallback) for x in ("<0x41>", "<0x20>", "<0xFF>", "A")] == ["A", "Ġ", None, None]
    assert [one(spark, x, T.blank_run) for x in ("ĠĊ", "Ġa", "aĠbĉ")] == [True, False, True]
    assert one(spark, "ĠĠ", lambda c: T.placeholder(c, F.lit(3))) == "<unused_whitespace__3>"
    assert one(spark, "a/b/tok.x.json", T.path_name) == "tok.x"
    assert one(spark, [0, 72, 105, 0], T.surface_text, "array<int>") == "Hi"
    end, table = "<|endoftext|>", {c: b for b, c in T.byte_alphabet().items()}
    for piece, want in ((end, None), (f"a{end}b", f"a{end}b"), ("", "")):
        assert one(spark, [0, *[table[c] for c in piece]], T.surface_text, "array<int>") == want
