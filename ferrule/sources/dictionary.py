"""Dictionary exports: CSV files to typed tables, last row of a key wins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.sources.sniff import CHARSETS, mended, sniffed


@dataclass(frozen=True)
class Export:
    """One export: file stem, key columns, renamed columns, whole-number columns, flags that hold if the value is one."""

    stem: str
    key: tuple[str, ...]
    columns: dict[str, str]
    numbers: tuple[str, ...] = ()
    flags: dict[str, str] = field(default_factory=dict)


#: The exports of the data dictionary.
EXPORTS = (
    Export("sx2", ("code",), {"X2_CHAVE": "code", "X2_NOME": "name", "X2_MODO": "mode"}),
    Export("sx3", ("table_code", "field"), {"X3_ARQUIVO": "table_code", "X3_CAMPO": "field", "X3_TIPO": "type", "X3_TAMANHO": "size", "X3_DECIMAL": "decimals", "X3_TITULO": "title", "X3_DESCRIC": "description", "X3_VALID": "validation", "X3_RELACAO": "init", "X3_OBRIGAT": "required", "X3_F3": "lookup", "X3_CBOX": "options", "X3_VLDUSER": "user_validation", "X3_WHEN": "when_expr", "X3_PROPRI": "owner", "X3_GRPSXG": "field_group"}, ("size", "decimals"), {"required": "X"}),
    Export("six", ("table_code", "ord"), {"INDICE": "table_code", "ORDEM": "ord", "CHAVE": "key", "DESCRICAO": "description", "PROPRI": "owner", "NICKNAME": "nickname"}),
    Export("sx7", ("source", "seq"), {"X7_CAMPO": "source", "X7_SEQUENC": "seq", "X7_CDOMIN": "target", "X7_REGRA": "rule", "X7_TIPO": "kind", "X7_ALIAS": "alias", "X7_CONDIC": "condition", "X7_PROPRI": "owner", "X7_SEEK": "seek", "X7_CHAVE": "key"}),
    Export("sx6", ("branch", "name"), {"X6_FIL": "branch", "X6_VAR": "name", "X6_TIPO": "type", "X6_DESCRIC": "description", "X6_CONTEUD": "content", "X6_PROPRI": "owner", "X6_VALID": "validation", "X6_INIT": "init"}),
    Export("sx1", ("grp", "ord"), {"X1_GRUPO": "grp", "X1_ORDEM": "ord", "X1_PERGUNT": "prompt", "X1_VARIAVL": "variable", "X1_TIPO": "type", "X1_TAMANHO": "size", "X1_DECIMAL": "decimals", "X1_F3": "lookup", "X1_VALID": "validation", "X1_DEF01": "preset"}, ("size", "decimals")),
    Export("sx5", ("branch", "table_code", "key"), {"X5_FILIAL": "branch", "X5_TABELA": "table_code", "X5_CHAVE": "key", "X5_DESCRI": "description"}),
    Export("sx9", ("source", "ident", "target"), {"X9_DOM": "source", "X9_IDENT": "ident", "X9_CDOM": "target", "X9_EXPDOM": "source_expr", "X9_EXPCDOM": "target_expr", "X9_PROPRI": "owner", "X9_CONDSQL": "condition"}),
    Export("sxa", ("alias", "ord"), {"XA_ALIAS": "alias", "XA_ORDEM": "ord", "XA_DESCRIC": "description", "XA_PROPRI": "owner", "XA_AGRUP": "grp"}),
    Export("sxb", ("alias", "kind", "seq", "col"), {"XB_ALIAS": "alias", "XB_TIPO": "kind", "XB_SEQ": "seq", "XB_COLUNA": "col", "XB_DESCRI": "description", "XB_CONTEM": "content"}),
    Export("sxg", ("grp",), {"XG_GRUPO": "grp", "XG_DESCRIC": "description", "XG_TAMANHO": "size", "XG_TAMMAX": "most", "XG_TAMMIN": "least"}, ("size", "most", "least")),
    Export("xxa", ("domain", "code", "seq"), {"XXA_DOM": "domain", "XXA_CDOM": "code", "XXA_SEQUEN": "seq", "XXA_DESCRI": "description", "XXA_DSCSPA": "description_es", "XXA_DSCENG": "description_en", "XXA_TYPE": "type"}),
    Export("xal", ("branch", "id"), {"XAL_FILIAL": "branch", "XAL_ID": "id", "XAL_DESC": "description", "XAL_TIPO": "kind", "XAL_PROPRI": "owner"}),
    Export("xam", ("branch", "alias", "field"), {"XAM_FILIAL": "branch", "XAM_CLASSI": "class", "XAM_ANONIM": "anonymise", "XAM_JUSTIF": "reason", "XAM_FIELD": "field", "XAM_MODULE": "module", "XAM_ALIAS": "alias", "XAM_IDENT": "ident", "XAM_PROPRI": "owner", "XAM_SINUSE": "in_use"}),
    Export("schedules", ("code",), {"Codigo": "code", "Rotina": "routine", "Empresa_Filial": "company", "Environment": "environment", "Modulo": "module", "Status": "status", "Tipo_Recorrencia": "recurrence", "Hora_Inicio": "start"}),
    Export("jobs", ("file", "section"), {"Arquivo": "file", "Sessao": "section", "Rotina_Main": "routine", "RefreshRate": "refresh", "Parametros": "parameters"}),
    Export("mpmenu_menu", ("id",), {"M_ID": "id", "M_NAME": "name", "M_VERSION": "version", "M_MODULE": "module", "M_DEFAULT": "preset"}),
    Export("mpmenu_item", ("id",), {"I_ID_MENU": "menu", "I_ID": "id", "I_FATHER": "parent", "I_ORDER": "ord", "I_ID_FUNC": "function", "I_TYPE": "type", "I_TABLES": "tables", "I_MODULE": "module"}),
    Export("mpmenu_function", ("id",), {"F_ID": "id", "F_FUNCTION": "function", "F_DEFAULT": "preset"}),
    Export("mpmenu_i18n", ("kind", "parent", "lang"), {"N_PAREN_TP": "kind", "N_PAREN_ID": "parent", "N_LANG": "lang", "N_DESC": "description"}),
    Export("mpmenu_key_words", ("item", "lang"), {"K_ID_ITEM": "item", "K_LANG": "lang", "K_DESC": "words"}),
    Export("mpmenu_rw", ("lang",), {"R_LANG": "lang", "R_DESC": "words"}),
)
DELETED = ("D_E_L_E_T_", "R_E_C_D_E_L_")


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text. Without ``sep`` the header line tells it; a spreadsheet in disguise is an error."""
    if sep is None:
        head = spark.read.text(path).limit(1).collect()
        first = head[0][0] if head else ""
        if first.startswith("PK\x03\x04"):
            raise ValueError(f"{path} is a spreadsheet, not CSV")
        sep = max((",", ";", "\t"), key=first.count)
    df = spark.read.option("header", "true").option("sep", sep).option("encoding", CHARSETS.get(encoding, encoding)).option("quote", '"').option("escape", '"').option("multiLine", "true").csv(path)
    return mended(df, encoding)


def normalised(raw: DataFrame, export: Export) -> DataFrame:
    """Renamed, trimmed, typed rows without the logically deleted; missing columns are empty; blank keys are dropped."""
    have = {c.upper(): c for c in raw.columns}
    text = lambda c: F.trim(F.coalesce(F.col(f"`{have[c.upper()]}`"), F.lit(""))) if c.upper() in have else F.lit("")
    gone = [text(c) for c in DELETED if c in have]
    rows = raw
    for g in gone:
        rows = rows.where(g != "*")
    cols = []
    for c, to in export.columns.items():
        x = text(c)
        x = F.coalesce(x.try_cast("int"), F.lit(0)) if to in export.numbers else (F.upper(x) == export.flags[to]) if to in export.flags else x
        cols.append(x.alias(to))
    return rows.select(*cols).where(F.col(export.key[-1]) != "")


def last_wins(rows: DataFrame, key: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): the last row of each key in file order, and read and lost rows.

    File order is the row's running id of the scan: files in path order, splits in offset order.
    """
    numbered = rows.withColumn("_at", F.monotonically_increasing_id())
    rest = [c for c in rows.columns if c not in key]
    kept = numbered.groupBy(*key).agg(F.max(F.struct("_at", *rest)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)
    counts = rows.agg(F.count("*").alias("n_read"), F.count_distinct(F.struct(*key)).alias("n_kept")).withColumn("n_lost", F.col("n_read") - F.col("n_kept"))
    return kept, counts


def custom_table(code):
    """Whether a table code lies in the ranges left to customers: SZ and a sign, Q with a letter and a sign, Z and one sign or two."""
    return F.upper(code).rlike(r"^(SZ[A-Z0-9]|Q[A-Z][A-Z0-9]|Z[A-Z0-9]{1,2})$")


def custom_field(name, owner=None):
    """Whether a field is a customer's: its second part starts with X, or its owner flag says so."""
    own = F.upper(F.split_part(name, F.lit("_"), F.lit(2))).startswith("X")
    return own if owner is None else own | (F.upper(F.trim(owner)) == "U")


def load(spark: SparkSession, folder: str, stems: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The exports of a folder by stem, each in the encoding and with the delimiter that its first bytes tell; absent ones are left out."""
    names = {f"{e.stem}.csv": e for e in EXPORTS if not stems or e.stem in stems}
    found = [r for r in sniffed(spark, folder, pattern="*.csv").collect() if r.path.rsplit("/", 1)[-1] in names]  # a row a file
    out = {}
    for r in sorted(found, key=lambda r: r.path):
        if r.encoding == "spreadsheet":
            raise ValueError(f"{r.path} is a spreadsheet, not CSV")
        e = names[r.path.rsplit("/", 1)[-1]]
        out[e.stem] = last_wins(normalised(read_csv(spark, r.path, r.sep, r.encoding), e), e.key)[0]
    return out


def physical_counts(tables: DataFrame, counts: DataFrame) -> DataFrame:
    """Tables with the rows of their physical files, summed by the first three characters; system files skipped."""
    code = F.upper(F.substring("TABLE_NAME", 1, 3))
    n = counts.where(~F.upper("TABLE_NAME").rlike("^(TOP_|SYS|XX|MP_)")).groupBy(code.alias("code")).agg(F.sum(F.trim("NUM_ROWS").try_cast("long")).alias("num_rows"))
    return tables.join(n, "code", "left").withColumn("num_rows", F.coalesce("num_rows", F.lit(0)))


def catalog(spark: SparkSession, path: str, alias: str, sep: str | None = None) -> DataFrame:
    """A delimited file as (alias, row_id, row: map of text): blank rows skipped, short rows padded with nothing."""
    raw = read_csv(spark, path, sep)
    entries = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias("v")) for c in raw.columns]))
    rows = raw.select(F.monotonically_increasing_id().alias("row_id"), entries.alias("row"))
    return rows.where(F.exists(F.map_values("row"), lambda v: v != "")).select(F.lit(alias).alias("alias"), "row_id", "row")
