"""One form for texts that look the same, by DuckDB SQL inside Arrow partitions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import small

# Letters of other scripts, each with what it is drawn like.
LOOKALIKES = [
    ("аеорсухіјѕһԁԛԝӏѵү", "aeopcyxijshdqwlvy"),
    ("АВЕКМНОРСТУХІЈЅԌԚԜӀѴҮЗ", "ABEKMHOPCTYXIJSGQWIVY3"),
    ("ανορυιγϲϳ", "avopuiycj"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),
    ("օսոհցզյՕՍԼ", "ounhgqjOUL"),
    ("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEHJKLMPRSTVWZ"),
    ("カロニエタトハヘベペ", "力口二工夕卜八へべぺ"),
]
# Ligatures and what they join.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj", "Ǳ": "DZ", "ǲ": "Dz", "ǳ": "dz"}
#: Characters that leave no mark, as a class of DuckDB's regular expressions.
INVISIBLE = r"[\p{Cf}\x{0000}-\x{0008}\x{000E}-\x{001F}\x{007F}-\x{0084}\x{0086}-\x{009F}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180D}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}]"
SPACES = r"[\p{Z}\t\n\x{000B}\f\r\x{0085}]"
#: Blocks whose compatibility forms are widths or shapes of the same character: half and full width, CJK radicals and compatibility ideographs.
WIDTH_BLOCKS = [(0xFF01, 0xFFEE), (0x2F00, 0x2FD5), (0xF900, 0xFAD9)]
KNOWN_LIMIT = 20_000


def _width_table() -> dict[str, str]:
    table = {}
    for low, high in WIDTH_BLOCKS:
        for c in map(chr, range(low, high + 1)):
            plain = unicodedata.normalize("NFKC", c)
            if plain != c and len(plain) == 1:
                table[c] = plain
    return table


def _lookalike_tables() -> tuple[dict[str, str], dict[str, str]]:
    """Bare letters, and accented letters that are one character with their accent in both scripts."""
    bare = {a: b for source, target in LOOKALIKES for a, b in zip(source, target, strict=True)}
    accented = {}
    for c in map(chr, [*range(0x370, 0x530), *range(0x1F00, 0x2000)]):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and parts[0] in bare:
            whole = unicodedata.normalize("NFC", bare[parts[0]] + parts[1:])
            if len(whole) == 1:
                accented[c] = whole
    return bare, accented


def _translate(expression: str, table: dict[str, str]) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return f"translate({expression}, {quote(''.join(table))}, {quote(''.join(table.values()))})"


def _class(characters) -> str:
    """A class of DuckDB's regular expressions that holds some characters, by ranges."""
    codes, spans = sorted(map(ord, characters)), []
    for c in codes:
        if spans and c == spans[-1][1] + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


def _where(test: str, changed: str, same: str) -> str:
    return f"CASE WHEN regexp_matches({same}, '{test}') THEN {changed} ELSE {same} END"


def canonical_steps(column: str) -> list[str]:
    """The DuckDB expressions that lead to the one form of ``column`` one after another, each over the last one's result, named ``column`` too.

    Each begins with one test whether the text has anything that it changes, so
    plain texts, which are most, pass through untouched.
    """
    bare, accented = _lookalike_tables()
    joined = column
    for ligature, letters in LIGATURES.items():
        joined = f"replace({joined}, '{ligature}', '{letters}')"
    width = _width_table()
    spaces = f"regexp_replace(regexp_replace({column}, '{INVISIBLE}', '', 'g'), '{SPACES}', ' ', 'g')"
    # Only below U+0300 is every text its own composed form.
    composed = _where(r"[^\x{0000}-\x{02FF}\x{4E00}-\x{9FFF}]", f"nfc_normalize({column})", column)
    return [
        _where(_class(width), _translate(column, width), column), _where(_class(LIGATURES), joined, column), _where(f"{INVISIBLE}|{SPACES}", spaces, column), composed,
        _where(_class(bare), f"nfc_normalize({_translate(column, bare)})", column), _where(_class(accented), _translate(column, accented), column),
    ]


def canonicalise(df: DataFrame, columns: list[str], suffix: str = "_canonical") -> DataFrame:
    """``df`` with the one form of each of ``columns`` beside it, in a column of that name plus ``suffix``.

    Width and compatibility forms, ligatures, composed and decomposed accents,
    invisible characters, kinds of space and look-alike letters become one;
    case, visible accents, punctuation and runs of spaces stay. Null stays
    null, empty stays empty, texts of any length are taken whole, repeated
    rows are kept, and an empty table stays empty. A column that already has
    the new name is replaced.
    """
    made = [f"{c}{suffix}" for c in columns]
    base = df.drop(*made)
    schema = T.StructType([*base.schema.fields, *[T.StructField(m, T.StringType()) for m in made]])
    query = "SELECT t FROM texts"
    for step in canonical_steps("t"):
        query = f"SELECT {step} AS t FROM ({query})"
    places = [base.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        for batch in batches:
            new = []
            for p in places:
                # Each different text once; a single thread keeps the order of the rows.
                coded = batch.column(p).cast(pa.string()).dictionary_encode()
                con.register("texts", pa.table({"t": coded.dictionary}))
                forms = con.sql(query).to_arrow_table().column(0).cast(pa.string()).combine_chunks() if len(coded.dictionary) else pa.array([], pa.string())
                con.unregister("texts")
                forms = pa.concat_arrays(forms.chunks) if isinstance(forms, pa.ChunkedArray) else forms
                new.append(forms.take(coded.indices))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *made])

    return base.mapInArrow(run, schema)


def recognise(df: DataFrame, known: DataFrame, fields: list[str], row_id: str = "row_id") -> DataFrame:
    """(row_id, field, ref_id) of texts that look like a known text of their field without being identical to it.

    ``known`` has ref_id, field and known_text. A text that looks like several
    known ones gives a row for each; repeated rows give repeated answers; null
    texts and null known texts match nothing. Empty tables give no rows.

    Each text becomes one row per field and is compared by its one form. The
    known texts are broadcast after counting that they are at most
    ``KNOWN_LIMIT``; otherwise the equi-join is left to AQE.
    """
    texts = df.select(F.col(row_id).alias("__row"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x"))
    texts = canonicalise(texts.where("x.text is not null").select("__row", "x.field", "x.text"), ["text"], "_one")
    entries = canonicalise(known.where("known_text is not null").select("ref_id", F.col("field").alias("__field"), "known_text"), ["known_text"], "_one")
    same = (F.col("field") == F.col("__field")) & (F.col("text_one") == F.col("known_text_one"))
    found = texts.join(small(entries, KNOWN_LIMIT), same).where(F.col("text") != F.col("known_text"))
    return found.select(F.col("__row").alias(row_id), "field", "ref_id")
