"""Line classification and record extraction.

Narrow projections only: every line is classified with substring tests
(``contains``/``startswith``) and its fields are cut out with
``regexp_extract``.  No shuffle, no Python.

Output schema (``requests``): ``ord, file_path, log_type, ip, ts, ts_s,
method, url, request, status, size, username, tls_protocol, tls_cipher,
level, message, value, parsed``.  Lines that fail (``parsed = false``) stay in
the frame for the statistics (A6) and are filtered by the detectors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import prefix_int, sanitize

# --- fixed values: request vocabulary of the line classifier ---
HTTP_VERBS = ["GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "PRI", "CONNECT", "TRACE"]
WEBDAV_VERBS = ["PROPFIND", "PROPPATCH", "MKCOL", "COPY", "MOVE", "LOCK", "UNLOCK"]
ACCESS_PROTOCOL_MARKS = ['"t3 ', '"giop ', '"ldap ', '"ssh-', '"ftp ',
                         '"quit"', '"exit"', '"help"', '"ping"', '"test"']
SHORT_COMMANDS = ["quit", "exit", "help", "ping", "test"]
TLS_COMMANDS = ["quit", "exit", "help", "user", "pass", "list", "retr", "stor", "dele", "pwd",
                "cwd", "mkd", "rmd", "noop", "syst", "feat", "auth", "pbsz", "prot"]
# --- end of fixed values ---

# An escape-aware quoted field: JSON bodies with \" stay whole.  The possessive
# loops run without recursion, so a request of any length matches.
QUOTED = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
AFTER_QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*(.*)$'
ACCESS_TS = "dd/MMM/yyyy:HH:mm:ss"
ERROR_TS = "MMM dd HH:mm:ss yyyy"


def _any_contains(c: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles])


def classify_line(v: Column) -> Column:
    """Per-line format, first true test wins."""
    verbs = _any_contains(v, [f"{w} " for w in HTTP_VERBS])
    all_verbs = verbs | _any_contains(v, [f"{w} " for w in WEBDAV_VERBS])
    first_quote_nonempty = v.rlike(r'^[^"]*"[^"]')
    json_body = v.contains('"{') & (v.contains('"id":') | v.contains('\\"id\\":'))
    is_tls = ((v.contains("TLS") | v.contains("SSL")) & v.startswith("[") & v.contains("] ") & v.contains('"')
              & (verbs | json_body | v.contains('"" ') | v.contains('"-" ') | first_quote_nonempty))
    is_error = v.startswith("[") & _any_contains(v, ["] [error]", "] [warn]", "] [notice]", "[client ", "client denied"])
    access_shape = ((v.contains(" - - [") | v.contains(' - "" [')
                     | (v.contains(" - ") & v.contains(" [") & ~v.contains("] [")))
                    & v.contains('] "'))
    access_req = (all_verbs | v.contains('"-"') | v.contains('] "" ') | json_body
                  | v.contains('method":') | _any_contains(v, ACCESS_PROTOCOL_MARKS)
                  | (v.contains('" ') & ~v.contains("HTTP/")))
    is_ts_first = (v.startswith("[") & v.contains("] ") & v.contains(' - - "')
                   & (all_verbs | v.contains('"-"') | v.contains(' "" ')))
    is_nginx_error = v.rlike(r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2} \[\w+\] .*client: \S")
    return (F.when(is_tls, F.lit("ssl_request_log"))
            .when(is_error, F.lit("error_log"))
            .when(access_shape & access_req, F.lit("access_log"))
            .when(is_ts_first, F.lit("timestamp_first_access_log"))
            .when(is_nginx_error, F.lit("nginx_error_log"))
            .otherwise(F.lit("unknown")))


def _first_word(c: Column) -> Column:
    return F.regexp_extract(c, r"^(\S+)", 1)


def _access_request_kind(req: Column, body: Column, json_method: Column):
    """R2, access and timestamp-first lines -> (method, url)."""
    w1 = F.regexp_extract(req, r"^([^ ]*)", 1)
    rest = F.regexp_extract(req, r"^[^ ]* (.*)$", 1)
    has_http = req.contains("HTTP/")
    word1 = F.regexp_extract(req, r"^\s*(\S+)", 1)
    # all between the method and a last " HTTP/x": a blank does not end the url
    word2 = F.regexp_extract(req, r"^\s*\S+\s+(.*?)(?:\s+HTTP/\S*)?\s*$", 1)
    is_json = body.startswith("{") & body.contains('"id":') & body.contains('"method":')
    method = (F.when(req == "-", F.lit("INCOMPLETE"))
              .when(is_json, F.lit("JSON-RPC"))
              .when(req == "", F.lit("EMPTY"))
              .when(req.startswith("t3 "), F.lit("T3"))
              .when(req.isin(*SHORT_COMMANDS), F.upper(req))
              .when(req.contains(" ") & ~has_http,
                    F.when(w1 != "", F.upper(w1)).otherwise(F.lit("NON_HTTP")))
              .when(~has_http, F.lit("NON_HTTP"))
              .otherwise(word1))
    url = (F.when(req == "-", F.lit("-"))
           .when(is_json, F.concat(F.lit("JSON:"), F.coalesce(json_method, F.lit("unknown"))))
           .when(req == "", F.lit(""))
           .when(req.startswith("t3 "), F.concat(F.lit("T3:"), F.regexp_extract(req, r"(?s)^...(.*)$", 1)))
           .when(req.isin(*SHORT_COMMANDS), F.concat(F.lit("CMD:"), req))
           .when(req.contains(" ") & ~has_http,
                 F.when(w1 != "", F.concat(F.lit("NON_HTTP:"), rest)).otherwise(req))
           .when(~has_http, F.concat(F.lit("CMD:"), req))
           .otherwise(word2))
    return method, url


def _tls_request_kind(req: Column, body: Column, json_method: Column, cmd: Column):
    """R2, TLS request-log lines -> (method, url); ``cmd`` is the command that the request begins with, or NULL."""
    w1 = F.regexp_extract(req, r"^([^ ]*)", 1)
    after = F.regexp_extract(req, r"^[^ ]* (.*)$", 1)
    url2 = F.regexp_extract(after, r"^(.*?)(?: +HTTP/\S*)?\s*$", 1)
    jm_ok = json_method.isNotNull() & (json_method != "")
    method = (F.when(req == "", F.lit("SSL_EMPTY"))
              .when(req == "-", F.lit("SSL_INCOMPLETE"))
              .when(req.startswith("{"),
                    F.when(jm_ok, F.concat(F.lit("JSON:"), json_method)).otherwise(F.lit("JSON-RPC")))
              .when(cmd.isNotNull(), F.concat(F.lit("NON_HTTP:"), cmd))
              .when(req.contains(" "),
                    w1)
              .otherwise(req))
    url = (F.when(req == "", F.lit(""))
           .when(req == "-", F.lit("-"))
           .when(req.startswith("{"), body)
           .when(cmd.isNotNull(), req)
           .when(req.contains(" "), url2)
           .otherwise(F.lit("/")))
    return method, url


def parse_lines(lines: DataFrame) -> DataFrame:
    """``lines(ord, file_path, value)`` -> ``requests``.

    Three stacked projections: the shared pieces (class, quoted request, text
    after it, bracket text) are materialised once as columns, so Catalyst does
    not inline a ``regexp_extract`` into every branch that uses it.

    P15: a record is parsed only if its client is an IPv4 or IPv6 address and,
    on access lines, its status has three digits.  No text is cut and no
    length decides a kind.
    """
    v = F.col("value")
    stage1 = lines.select(
        "ord", "file_path", "value",
        classify_line(v).alias("log_type"),
        v.rlike(QUOTED).alias("_has_quote"),
        F.regexp_extract(v, QUOTED, 1).alias("_req"),
        F.regexp_extract(v, AFTER_QUOTED, 1).alias("_after"),
        F.regexp_extract(v, r"\[([^\]]*)\]", 1).alias("_bracket"),
    )
    req = F.col("_req")
    stage2 = stage1.select(
        "*",
        F.regexp_replace(req, r'\\"', '"').alias("_body"),
        F.regexp_extract(F.col("_after"), r"^(\S+)", 1).alias("_tok1"),
        F.regexp_extract(F.col("_after"), r"^\S+\s+(\S+)", 1).alias("_tok2"),
        # read off once: the tests of a request's kind look at it several times
        F.when(F.col("log_type") == "ssl_request_log", F.nullif(F.regexp_extract(
            F.lower(F.substring(req, 1, max(map(len, TLS_COMMANDS)))), "^(" + "|".join(TLS_COMMANDS) + ")", 1), F.lit(""))).alias("_cmd"),
    ).withColumn("_json_method", F.when(F.col("_body").startswith("{"), F.get_json_object(F.col("_body"), "$.method")))

    has_quote = F.col("_has_quote")
    body = F.col("_body")
    json_method = F.col("_json_method")
    tok1 = F.col("_tok1")
    tok2 = F.col("_tok2")
    bracket = F.col("_bracket")

    lt = F.col("log_type")
    is_access = lt == "access_log"
    is_tsfirst = lt == "timestamp_first_access_log"
    is_tls = lt == "ssl_request_log"
    is_err = lt == "error_log"
    is_ngx = lt == "nginx_error_log"

    a_method, a_url = _access_request_kind(req, body, json_method)
    t_method, t_url = _tls_request_kind(req, body, json_method, F.col("_cmd"))

    after_bracket = F.regexp_extract(v, r"^\[[^\]]*\]\s+(\S+)", 1)
    tls_proto = F.regexp_extract(v, r"^\[[^\]]*\]\s+\S+\s+(\S+)", 1)
    tls_cipher = F.regexp_extract(v, r"^\[[^\]]*\]\s+\S+\s+\S+\s+(\S+)", 1)
    ngx_tls = F.regexp_extract(v, r"\s((?:TLSv[\d.]+|SSLv\d))\s+(\S+)\s*$", 1)
    ngx_cipher = F.regexp_extract(v, r"\s(?:TLSv[\d.]+|SSLv\d)\s+(\S+)\s*$", 1)

    # "[client 192.0.2.1:5678]", "[client [2001:db8::1]:5678]" or a bare address: only a port goes
    client = F.regexp_extract(v, r"\[client (\[[^\]]*\]|[^\]\s]+)", 1)
    client = F.regexp_replace(F.regexp_replace(client, r"^((?:\d{1,3}\.){3}\d{1,3}):\d+$", "$1"), r"^\[(.*)\]$", "$1")
    err_ip = F.coalesce(F.nullif(client, F.lit("")),
                        F.nullif(F.regexp_extract(v, r"client:? (\d{1,3}(?:\.\d{1,3}){3})", 1), F.lit("")),
                        F.nullif(F.regexp_extract(v, r"(\d{1,3}(?:\.\d{1,3}){3})", 1), F.lit("")))
    err_msg = F.coalesce(F.nullif(F.regexp_extract(v, r"\[client (?:\[[^\]]*\][^\]]*|[^\]]*)\] ?(.*)$", 1), F.lit("")),
                         F.nullif(F.regexp_extract(v, r"^(?:\[[^\]]*\]\s*)+(.*)$", 1), F.lit("")))
    ngx_msg = F.regexp_extract(v, r"^\S+ \S+ \[\w+\] (?:\d+#\d+: )?(?:\*\d+ )?(.*)$", 1)
    level = (F.when(is_err, F.regexp_extract(v, r"^\[[^\]]*\]\s+\[(?:[^\]:]*:)?([^\]:]*)\]", 1))
             .when(is_ngx, F.regexp_extract(v, r"^\S+ \S+ \[(\w+)\]", 1)))

    ip = (F.when(is_access, _first_word(v))
          .when(is_tsfirst | is_tls, after_bracket)
          .when(is_ngx, F.regexp_extract(v, r"client: ([^,\s]+)", 1))
          .when(is_err, err_ip))
    username = F.when(is_access, F.nullif(F.nullif(
        F.regexp_replace(F.regexp_extract(v, r"^\S+\s+\S+\s+(\S+)", 1), r'^"|"$', ""), F.lit("-")), F.lit("")))
    method = (F.when(is_access | is_tsfirst, a_method)
              .when(is_tls, t_method)
              .when(is_err | is_ngx, F.lit("ERROR_LOG")))
    message = F.when(is_err, err_msg).when(is_ngx, ngx_msg)

    tls_status_raw = prefix_int(tok1, "int")
    status = (F.when(is_access | is_tsfirst, tls_status_raw)
              .when(is_tls, F.when(~has_quote | (tok1 == ""), F.lit(200))
                    .when(tok1 == "-", F.lit(0))
                    .when(tls_status_raw.between(100, 599), tls_status_raw)
                    .otherwise(F.lit(200)))
              .when(is_err | is_ngx, F.lit(500)))
    size = (F.when(is_access | is_tsfirst, F.when(tok2 == "-", F.lit(None).cast("bigint")).otherwise(prefix_int(tok2)))
            .when(is_tls & tls_status_raw.isNotNull() & ~tls_status_raw.between(100, 599)
                  & (tls_status_raw > 0) & (tls_status_raw < 1000000), tls_status_raw.cast("bigint")))

    ts = (F.when(is_access | is_tsfirst | is_tls, F.try_to_timestamp(F.substring(bracket, 1, 20), F.lit(ACCESS_TS)))
          .when(is_err, F.try_to_timestamp(F.regexp_replace(F.regexp_extract(bracket, r"^\w+ (.*)$", 1), r"\.\d+ ", " "),
                                               F.lit(ERROR_TS)))
          .when(is_ngx, F.try_to_timestamp(F.substring(v, 1, 19), F.lit("yyyy/MM/dd HH:mm:ss"))))

    # an access line that only mentions TLS behind its request has no more to say than that
    some_tls = is_access & F.col("_after").rlike(r"\sTLS\b")
    tls_protocol = F.when(is_tls, tls_proto).when(is_access & (ngx_tls != ""), ngx_tls).when(some_tls, F.lit("TLS"))
    tls_cipher_c = (F.when(is_tls, tls_cipher).when(is_access & (ngx_tls != ""), ngx_cipher)
                    .when(some_tls, F.lit("unknown")))

    needs_request = is_access | is_tsfirst | is_tls
    stage3 = stage2.select(
        "ord", "file_path", "log_type", "value", "_has_quote", "_req",
        ip.alias("_ip"),
        ts.alias("ts"),
        method.alias("_method"),
        F.when(is_access | is_tsfirst, a_url).when(is_tls, t_url).alias("_url"),
        message.alias("message"),
        status.alias("status"),
        size.alias("size"),
        username.alias("_username"),
        tls_protocol.alias("tls_protocol"),
        tls_cipher_c.alias("tls_cipher"),
        level.alias("level"),
        tok1.rlike(r"^\d{3}$").alias("_status_ok"),
    )
    lt = F.col("log_type")
    is_err_any = lt.isin("error_log", "nginx_error_log")
    needs_request = lt.isin("access_log", "timestamp_first_access_log", "ssl_request_log")
    parsed = (F.when(needs_request, F.col("_has_quote") & is_address(F.col("_ip"))
                     & ((lt == "ssl_request_log") | F.col("_status_ok")))
              .when(is_err_any, is_address(F.col("_ip")))
              .otherwise(F.lit(False)))
    url = F.when(is_err_any, F.col("message")).otherwise(F.col("_url"))
    return stage3.select(
        "ord", "file_path", "log_type",
        sanitize(F.col("_ip")).alias("ip"),
        "ts",
        F.unix_timestamp(F.col("ts")).alias("ts_s"),
        sanitize(F.col("_method")).alias("method"),
        sanitize(url).alias("url"),
        F.when(needs_request, F.col("_req")).alias("request"),
        "status", "size",
        sanitize(F.col("_username")).alias("username"),
        "tls_protocol", "tls_cipher", "level", "message", "value",
        F.coalesce(parsed, F.lit(False)).alias("parsed"),
    )


def is_address(c: Column) -> Column:
    """An IPv4 address with parts up to 255, or the shape of an IPv6 address."""
    part = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.coalesce(c.rlike(rf"^{part}(?:\.{part}){{3}}$")
                      | (c.rlike(r"^[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*$")), F.lit(False))


def rejects(parsed: DataFrame) -> DataFrame:
    """Lines that gave no record, with the first reason: blank, comment, unknown format, no request,
    client or status."""
    v, lt = F.col("value"), F.col("log_type")
    why = (F.when(v.rlike(r"^\s*$"), "blank").when(v.rlike(r"^\s*#"), "comment").when(lt == "unknown", "format")
           .when(~is_address(F.col("ip")), "client")
           .when(lt.isin("access_log", "timestamp_first_access_log") & (F.col("request") != "")
                 & F.col("status").isNotNull(), "status").otherwise("request"))
    return parsed.filter(~F.col("parsed")).select("ord", "file_path", "log_type", why.alias("reason"), "value")


def requests_only(parsed: DataFrame) -> DataFrame:
    """Successfully parsed records (the detectors' input)."""
    return parsed.filter(F.col("parsed"))
