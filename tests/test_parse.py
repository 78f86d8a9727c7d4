from conftest import lines_df

from loghound.operators.parse import parse_lines, rejects, requests_only
from loghound.operators.signatures import core_signature_hits, shell_profile_hits

ACCESS = '198.51.100.20 - - [12/Mar/2024:09:15:30 +0000] "GET /shop/cart?item=7 HTTP/1.1" 200 512'
AUTH = '198.51.100.21 - maria [12/Mar/2024:09:15:31 +0000] "GET /reports HTTP/1.1" 401 99'
EMPTY = '198.51.100.22 - - [12/Mar/2024:09:15:32 +0000] "" 400 0'
INCOMPLETE = '198.51.100.23 - - [12/Mar/2024:09:15:33 +0000] "-" 408 -'
TLS_JSON = ('[12/Mar/2024:09:15:34 +0000] 198.51.100.24 TLSv1.3 TLS_AES_128_GCM_SHA256 '
            '"{\\"id\\":4,\\"method\\":\\"listUsers\\"}" 200')
TLS_OLD = '[12/Mar/2024:09:15:35 +0000] 198.51.100.25 SSLv3 RC4-SHA "GET /old HTTP/1.1" 7331'
TLS_QUIT = '[12/Mar/2024:09:15:36 +0000] 198.51.100.26 TLSv1.2 RC4-SHA "quit" 303'
TS_FIRST = '[12/Mar/2024:09:15:37 +0000] 198.51.100.27 - - "POST /form HTTP/1.1" 302 10'
ERROR = '[Tue Mar 12 09:15:38 2024] [error] [client 198.51.100.28:40112] File does not exist: /srv/a'
NGINX_ERR = '2024/03/12 09:15:39 [error] 77#0: *9 open() failed, client: 198.51.100.29, server: demo'
JUNK = 'no log line at all'


def _rows(spark, lines):
    return {r["ord"]: r for r in parse_lines(lines_df(spark, lines)).collect()}


def _access(request, status="200", ip="198.51.100.40"):
    return f'{ip} - - [12/Mar/2024:09:16:00 +0000] "{request}" {status} 5'


def test_formats(spark):
    rows = _rows(spark, [ACCESS, AUTH, EMPTY, INCOMPLETE, TLS_JSON, TLS_OLD, TLS_QUIT, TS_FIRST, ERROR,
                         NGINX_ERR, JUNK])
    a = rows[0]
    assert (a.log_type, a.ip, a.method, a.url, a.status, a.size) == ("access_log", "198.51.100.20", "GET",
                                                                      "/shop/cart?item=7", 200, 512)
    assert a.ts_s == 1710234930
    assert rows[1].username == "maria" and rows[1].status == 401
    assert (rows[2].method, rows[2].url, rows[2].status) == ("EMPTY", "", 400)
    assert (rows[3].method, rows[3].url, rows[3].size) == ("INCOMPLETE", "-", None)
    t = rows[4]
    assert (t.log_type, t.ip, t.method, t.url, t.tls_protocol) == (
        "ssl_request_log", "198.51.100.24", "JSON:listUsers", '{"id":4,"method":"listUsers"}', "TLSv1.3")
    assert (rows[5].status, rows[5].size) == (200, 7331)
    assert rows[6].method == "NON_HTTP:quit"
    assert (rows[7].log_type, rows[7].ip, rows[7].method) == ("timestamp_first_access_log", "198.51.100.27", "POST")
    e = rows[8]
    assert (e.log_type, e.ip, e.method, e.status, e.level) == ("error_log", "198.51.100.28", "ERROR_LOG", 500, "error")
    assert e.url.startswith("File does not exist")
    assert rows[9].log_type == "nginx_error_log" and rows[9].ip == "198.51.100.29"
    assert rows[10].parsed is False and all(rows[i].parsed for i in range(10))


def test_long_texts_hide_nothing(spark):
    attack = "GET /q?a=union%20select%201&pad={} HTTP/1.1"
    five_fold = "%25252527%25252520or%252525201=1"
    lines = [_access(attack.format("x" * 1100)), _access(attack.format("x" * 20000)),
             _access("verb" + "x" * 30 + " /a"), _access(f"GET /a?b=..%2525252f..%2525252fetc&c={five_fold} HTTP/1.1")]
    parsed = parse_lines(lines_df(spark, lines))
    rows = {r.ord: r for r in core_signature_hits(requests_only(parsed)).collect()}
    assert len(rows) == 4 and len(rows[1].url) > 20000
    assert rows[0].sql_hit is not None and rows[1].sql_hit is not None
    assert rows[2].method == "VERB" + "X" * 30
    deep = {r.ord: r for r in shell_profile_hits(requests_only(parsed), True).collect()}
    assert deep[3].trv_rx and deep[3].sql_rx


def test_error_lines(spark):
    lines = ["[Tue Mar 12 09:20:01.123456 2024] [core:error] [pid 5:tid 9] [client 2001:db8::1] denied",
             "[Tue Mar 12 09:20:02 2024] [error] [client [2001:db8::2]:4433] denied",
             "[Tue Mar 12 09:20:03 2024] [error] [client 192.0.2.9:80] ../../../etc/passwd union select 1"]
    rows = _rows(spark, lines)
    assert [rows[i].ip for i in range(3)] == ["2001:db8::1", "2001:db8::2", "192.0.2.9"]
    assert rows[0].ts_s == 1710235201 and rows[0].level == "error"
    shell = shell_profile_hits(requests_only(parse_lines(lines_df(spark, lines))), True).collect()
    assert not any(r.sql_rx or r.trv_rx for r in shell)


def test_rejects(spark):
    lines = ["", "# GET /x HTTP/1.1 - - [a] \"GET / HTTP/1.1\" 200 1", JUNK, _access("GET / HTTP/1.1", ip="host.example"),
             _access("GET / HTTP/1.1", status="abc"), _access("GET / HTTP/1.1", ip="1.2.3.400"), ACCESS]
    got = {r.ord: r.reason for r in rejects(parse_lines(lines_df(spark, lines))).collect()}
    assert got == {0: "blank", 1: "comment", 2: "format", 3: "client", 4: "request", 5: "client"}


def test_blanks_tls_and_nginx_clients(spark):
    at = "[01/Aug/2025:10:00:00 +0000]"
    lines = [
        f'198.51.100.7 - - {at} "GET /?q=union select aaa HTTP/1.1" 200 5',
        f'{at} 198.51.100.7 TLSv1.3 X-Y "GET /?q=union select b HTTP/1.1" 200',
        f'198.51.100.7 - - {at} "GET /a  HTTP/1.1" 200 5',
        "2025/08/01 10:00:00 [error] 1#2: *3 open() failed, client: 2001:db8::2, server: x",
        "2025/08/01 10:00:00 [error] 1#2: *3 open() failed, client: 198.51.100.9, server: x",
        "2025/08/01 10:00:00 [error] 1#2: *3 open() failed, client: nobody, server: x",
        f'{at} 198.51.100.7 TLSv1.3 X-Y "GET /a HTTP/1.1" -',
        f'198.51.100.7 - - {at} "GET /a HTTP/1.1" 200 5 "-" "agent" TLSv1.2 ECDHE-X',
        f'198.51.100.7 - - {at} "GET /a HTTP/1.1" 200 5 "-" "agent" TLS handshake',
    ]
    r = {x.ord: x for x in parse_lines(lines_df(spark, lines)).collect()}
    assert [r[i].url for i in range(3)] == ["/?q=union select aaa", "/?q=union select b", "/a"]
    assert [(r[i].ip, r[i].parsed) for i in (3, 4)] == [("2001:db8::2", True), ("198.51.100.9", True)] and not r[5].parsed
    assert r[6].status == 0 and r[6].parsed
    assert (r[7].tls_protocol, r[7].tls_cipher) == ("TLSv1.2", "ECDHE-X")
    assert (r[8].tls_protocol, r[8].tls_cipher) == ("TLS", "unknown")
