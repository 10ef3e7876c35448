"""Reading the usage tables from files or from a gateway database."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from meterlens import schemas
from meterlens.operators.filters import ID_BLOCK


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Select the columns of `schema` in order, cast; a column the source lacks becomes NULL."""
    present = {name.lower(): name for name in df.columns}
    fields = T.StructType.fromDDL(schema).fields
    return df.select(
        *[
            (F.col(f"`{present[f.name.lower()]}`") if f.name.lower() in present else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in fields
        ]
    )


def read_usage_logs(spark: SparkSession, path: str) -> DataFrame:
    """Usage logs from Parquet. With the schema given no file has to be opened to plan the scan, and columns that
    older files lack are NULL."""
    return spark.read.schema(schemas.USAGE_LOGS).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TOKENS).parquet(path)


def read_options(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.OPTIONS).parquet(path)


# URL prefixes that name a database.
JDBC_PREFIXES = {
    "postgres://": "postgresql", "postgresql://": "postgresql", "mysql://": "mysql", "sqlite://": "sqlite",
    "sqlite3://": "sqlite", "file:": "sqlite",
}
MYSQL_DSN = re.compile(r"(?:(?P<user>[^:@/]*)(?::(?P<password>.*))?@)?(?:(?:tcp)\((?P<host>[^)]*)\))?/(?P<rest>[^/]*)")


def jdbc_address(dsn: str) -> tuple[str, dict[str, str]]:
    """The JDBC URL of a database address, and its user and password as reader options.

    Known are JDBC URLs, URLs of PostgreSQL, MySQL and SQLite, `key=value` lists of PostgreSQL,
    `user:password@tcp(host:port)/name` of MySQL, and names of SQLite files (`file:` or ending in .db or .sqlite).
    """
    text = dsn.strip()
    if text.startswith("jdbc:"):
        return text, {}
    for prefix, driver in JDBC_PREFIXES.items():
        if text.lower().startswith(prefix):
            rest = text[len(prefix) :]
            if driver == "sqlite":
                return f"jdbc:sqlite:{rest}", {}
            login, _, place = rest.rpartition("@")
            user, _, password = login.partition(":")
            return f"jdbc:{driver}://{place}", _login(unquote(user), unquote(password))
    if re.search(r"(^|\s)(host|dbname)\s*=", text):
        found = {k.lower(): v[1:-1] if v[:1] == "'" else v for k, v in re.findall(r"(\w+)\s*=\s*('[^']*'|\S+)", text)}
        known = ("host", "port", "dbname", "user", "password")
        port = f":{found['port']}" if "port" in found else ""
        more = "&".join(f"{k}={quote(v)}" for k, v in found.items() if k not in known)
        url = f"jdbc:postgresql://{found.get('host', 'localhost')}{port}/{found.get('dbname', '')}"
        return url + (f"?{more}" if more else ""), _login(found.get("user", ""), found.get("password", ""))
    if re.search(r"\.(db|sqlite3?)$", text.lower()):
        return f"jdbc:sqlite:{text}", {}
    dsn_parts = MYSQL_DSN.fullmatch(text)
    if dsn_parts and ("@" in text or dsn_parts["host"]):
        login = _login(dsn_parts["user"] or "", dsn_parts["password"] or "")
        return f"jdbc:mysql://{dsn_parts['host'] or 'localhost'}/{dsn_parts['rest']}", login
    raise ValueError("name the database as jdbc:..., postgres://..., mysql://..., sqlite://..., a DSN or a SQLite file")


def _login(user: str, password: str) -> dict[str, str]:
    return {k: v for k, v in (("user", user), ("password", password)) if v}


def read_usage_logs_jdbc(
    spark: SparkSession, dsn: str, first_id: int, last_id: int, partitions: int, **options: str
) -> DataFrame:
    """Usage logs from the gateway database, read in parallel id ranges; filters are pushed into its SQL."""
    url, login = jdbc_address(dsn)
    reader = (
        spark.read.format("jdbc")
        .option("url", url)
        .options(**login)
        .option("dbtable", "logs")
        .option("partitionColumn", "id")
        .option("lowerBound", first_id)
        .option("upperBound", last_id)
        .option("numPartitions", partitions)
        .options(**options)
    )
    return conform(reader.load(), schemas.USAGE_LOGS)


def write_usage_logs(logs: DataFrame, path: str) -> None:
    """Append logs in folders by day and block of ids: time ranges read only their days, a lookup only one block.

    A folder holds at most `ID_BLOCK` rows, so files keep their size however many rows a day has.
    """
    day = F.date_from_unix_date((F.floor(F.col("created_at") / 86400)).cast("int"))
    (
        logs.withColumns({"event_date": day, "id_block": F.floor(F.col("id") / ID_BLOCK).cast("long")})
        .repartition("event_date", "id_block")
        .sortWithinPartitions("event_date", "id_block", "token_id", "created_at")
        .write.mode("append")
        .partitionBy("event_date", "id_block")
        .parquet(path)
    )
