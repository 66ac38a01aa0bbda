import pyarrow as pa
import pyarrow.parquet as pq
import pytest

PROSE = "the quick brown fox jumps over a lazy dog while seven small birds sing near the old river bank and nobody hears them at all today"


def thue_morse(n, a, b):
    """Two different texts of n parts, of which any polynomial hash modulo 2**64 is equal from 1,024 parts on."""
    return ["".join((a, b)[(i.bit_count() + k) % 2] for i in range(n)) for k in (0, 1)]


def write(folder, **tables):
    for name, (schema, rows) in tables.items():
        kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
        names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        pq.write_table(pa.table({n: pa.array(col, kinds[t]) for n, t, col in zip(names, types, columns, strict=True)}), folder / f"{name}.parquet")
    return str(folder)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, kept string, leader int, _cuts string, band long"


def hard_documents():
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(60_000))
    texts = [
        (0, PROSE), (1, PROSE), (2, PROSE.upper()), (3, None), (4, ""), (5, "   \n\t "), (6, "x"), (7, "a b c"), (8, "a b c"),
        (9, long), (10, long + " end"), (11, "\n".join([PROSE] * 3)), (12, "\u00e9\u00fc \u4e2d\u6587 \U0001f600 word"), (13, "123 456 !!! ..."),
        (13, "123 456 !!! ..."), (14, "same id first"), (14, "same id second"), (None, "no id at all"), (None, None), (15, "nul \x00 inside \x1f text <|endoftext|> on"),
        (16, PROSE + " and then something else entirely follows here"), (17, ("tok " * 300).strip()), (18, ("tok " * 300).strip()), (19, "-" * 5000), (-5, "negative id"),
        *zip((20, 21, 22, 23), thue_morse(2048, "a", "b") + thue_morse(2048, "a ", "b "), strict=True),
    ]
    langs = ["en", None, "de", "en", "fr"]
    return [(i, t, langs[k % 5], None if k % 7 == 0 else f"src{k % 3}", None if t is None else len(t), 7, "kept", 3, "cuts", 1) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def hard(tmp_path_factory):
    return write(
        tmp_path_factory.mktemp("hard"),
        documents=(DOCS, hard_documents()),
        benchmark=("item_id long, text string, h long", [(1, " ".join(PROSE.split()[:15]), 0), (2, "a b", 0), (3, None, 0), (4, "", 0), (None, "x", 0), (5, "fox JUMPS over", 0), (5, "fox jumps over", 0), (10, "a b", 0), (11, thue_morse(2048, "a", "b")[0], 0)]),
        labels=("doc_id long, quality int, toxic int, label int", [(0, 1, 0, 9), (0, 0, 0, 9), (9, 1, 0, 9), (11, None, 0, 9), (13, 0, 0, 9), (14, 2, 0, 9), (None, 1, 0, 9), (19, 0, 1, 9)]),
        pages=("page_id long, url string, html string, host string, rule string", [
            (1, "http://EN.Example.NET/en/x?q#f", "<html lang=en><title>A &amp; B</title><p>one<p>two <b>three</b><script>no</script>", "h", "r"), (2, None, None, "h", "r"), (3, "no scheme/en/", "", "h", "r"),
            (4, "https://a.net", "plain", "h", "r"), (5, "https://net/", "<!-- open", "h", "r"), (6, "x://shop.example.com/de/a://b.net/", "<p>" * 20000, "h", "r"), (7, "https://notexample.net.org/fr/", "<div>é<br>ü</div>", "h", "r"),
            (1, "http://EN.Example.NET/en/x?q#f", "<html lang=en>", "h", "r"), (None, "ftp://u@h:80/p?x/y#z", "a<b", "h", "r"), (8, "http://x.net?a=/en/", "t", "h", "r"), (9, "http://fr.org#/fr/", "t", "h", "r"), (10, "http://example.com/de/\nq", "t", "h", "r"),
        ]),
        conversations=("conv_id long, turn long, role string, text string, window long", [
            (1, 0, "system", "be kind", 0), (1, 2, "assistant", "\\### x </turn> \\\\", 0), (1, 1, "user", "hi ### there", 0), (1, 3, "assistant", "", 0),
            (2, 0, "user", None, 0), (2, 0, "user", None, 0), (2, None, None, "tie", 0), (3, 0, "assistant", "word " * 5000, 0), (3, 1, "us\ner:", "\n</turn>\n", 0),
            (None, 0, "user", "lost", 0), (None, 1, "assistant", "found", 0),
        ]),
    )


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(
        tmp_path_factory.mktemp("empty"),
        documents=("doc_id long, text string, lang string, source string, n_chars long", []),
        benchmark=("item_id long, text string", []),
        labels=("doc_id long, quality int, toxic int", []),
        pages=("page_id long, url string, html string", []),
        conversations=("conv_id long, turn long, role string, text string", []),
    )
