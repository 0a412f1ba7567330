import unicodedata

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark.functions.normalize import byte_offsets, decoded_prefix, fold, normalized_ascii, origins, valid_prefix


def slow(text):
    """fold and its offsets, one code point at a time."""
    out, at = [], []
    for i, c in enumerate(text):
        for d in unicodedata.normalize("NFKD", c):
            if unicodedata.combining(d):
                continue
            d = d.lower() if len(d.lower()) == 1 else d
            d = " " if d.isspace() else d
            if d == " " and (not out or out[-1] == " "):
                continue
            out.append(d)
            at.append(i)
    return "".join(out), [*at, len(text)]


def test_traps():
    assert fold("ΟΔΟΣ") == "οδοσ"  # no rule for a final sigma
    assert fold("ﬁnal") == "final" and origins("ﬁnal").tolist() == [0, 0, 1, 2, 3, 4]
    assert fold("John  Smith") == "john smith"
    assert fold("brøød") == "brøød"
    assert fold("M. Quill\u205fx") == "m. quill x"
    assert fold("İx") == "ix"
    assert fold("กิ") == "กิ"  # a mark of class 0 stays
    assert fold("a​b") == "a​b"
    assert fold("  a \n\t b  ") == "a b "
    assert fold("") == "" and origins("").tolist() == [0]
    assert fold("\x00a") == "\x00a"


@given(st.text(max_size=40))
def test_fold_and_origins_equal_the_slow_way(text):
    text = text.encode("utf-8", "ignore").decode()
    assert (fold(text), origins(text).tolist()) == slow(text)


@given(st.text(max_size=30))
def test_byte_offsets(text):
    text = text.encode("utf-8", "ignore").decode()
    assert byte_offsets(text).tolist() == [len(text[:i].encode()) for i in range(len(text) + 1)]


def test_valid_prefix():
    assert valid_prefix(b"Mara Quill\xffMara") == "Mara Quill" and valid_prefix(b"\xffx") == "" and valid_prefix("é".encode()[:1]) == ""
    assert valid_prefix(b"") == "" and valid_prefix(None) is None


@given(st.text(alphabet=st.sampled_from(list("aZ. \t\x0b\r\n\x1c\u00a0é\U0001d41a")), max_size=40))
def test_plain_fold_and_origins_equal_the_slow_way(text):
    out, at = [], []
    for i, c in enumerate(text):
        d = " " if c in "\t\n\x0b\x0c\r ." else chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if d == " " and (not out or out[-1] == " "):
            continue
        out.append(d)
        at.append(i)
    assert (fold(text, "ascii"), origins(text, "ascii").tolist()) == ("".join(out), [*at, len(text)])
    assert origins(text, "none").tolist() == [*range(len(text) + 1)] and fold(text, "none") == text


def test_plain_fold_equals_the_column(spark):
    texts = ["  .A b..C\t\n\u00a0d É", "", "...", "x\x1cY"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(normalized_ascii(F.col("t"))).collect()
    assert [r[0] for r in got] == [fold(t, "ascii") for t in texts]


def test_bad_bytes_cut_the_text_where_they_stand(spark):
    raws = [b"\xffabc", b"ab\xc3", "é€".encode() + b"\x80x", b"", None, b"abc"]
    got = spark.createDataFrame([(r,) for r in raws], "r binary").select(decoded_prefix("r")).collect()
    assert [r[0] for r in got] == ["", "ab", "é€", "", None, "abc"]
