"""Signature tables (the replaceable extension point of the detectors).

Profile ``core`` uses substring-conjunction signatures: a signature hits a
lower-cased text when every clause has one contained term; ``unless`` terms
veto the hit.  Profiles ``fast``/``detailed`` use regular expressions on the
lower-cased text.  The tables are plain data; :func:`pattern_library` turns
them into a DataFrame a user can inspect, filter or replace.

All tables below are fixed values that must stay equal to the reference rule
set (ids, order, terms and reason suffixes).  Entries the reference lists but
never evaluates carry their intended meaning (SQL-024/025/044/045/048/049,
SHL-017/018) and the intended high-risk flag (SHL-003/107/119/121).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL_REASON = "SQLインジェクション攻撃の可能性"
SHELL_REASON = "シェルインジェクション攻撃の可能性"
TRAVERSAL_REASON = "ディレクトリトラバーサル攻撃の可能性"
COMPLEX_SHELL_REASON = "複合シェルインジェクション攻撃"
SQL_UNLESS = ["not found", "error", "failed", "denied"]

# --- fixed values: SQL family, profile core (id, label, clauses, unless, reason suffix) ---
SQL_SIGNATURES = [
    ("SQL-001", "union.*select", [["union"], ["select"]], [], "UNION SELECT攻撃"),
    ("SQL-002", "drop.*table", [["drop"], ["table"]], [], "DROP TABLE攻撃"),
    ("SQL-003", "insert.*into", [["insert"], ["into"], ["values", "select", "table"]], [], ""),
    ("SQL-004", "update.*set", [["update"], ["set"], ["where", "=", "table", "values"]], [], ""),
    ("SQL-005", "delete.*from", [["delete"], ["from"], ["where", "table", "limit"]], [], ""),
    ("SQL-006", "script.*alert", [["script"], ["alert"]], [], "XSS複合攻撃"),
    ("SQL-007", "javascript:", [["javascript:"]], [], "XSS複合攻撃"),
    ("SQL-008", "onload=", [["onload="]], [], ""),
    ("SQL-009", "onerror=", [["onerror="]], [], ""),
    ("SQL-010", "%27.*union", [["%27"], ["union"]], [], "URLエンコード攻撃"),
    ("SQL-011", "%22.*select", [["%22"], ["select"]], [], "URLエンコード攻撃"),
    ("SQL-012", "%3c.*script", [["%3c"], ["script"]], [], "XSS複合攻撃"),
    ("SQL-013", "%3e.*script", [["%3e"], ["script"]], [], "XSS複合攻撃"),
    ("SQL-014", "exec.*xp_", [["exec"], ["xp_"]], [], ""),
    ("SQL-015", "sp_.*password", [["sp_"], ["password"]], [], ""),
    ("SQL-016", "information_schema", [["information_schema"], ["select", "from", "union", "where"]], SQL_UNLESS, "DB情報収集攻撃"),
    ("SQL-017", "mysql.*user", [["mysql"], ["user"], ["select", "from", "table", "database"]], SQL_UNLESS, ""),
    ("SQL-018", "pg_.*user", [["pg_"], ["user"], ["select", "from", "table", "database"]], SQL_UNLESS, ""),
    ("SQL-019", "waitfor.*delay", [["waitfor"], ["delay"]], [], ""),
    ("SQL-020", "benchmark.*\\(", [["benchmark"], ["("]], [], "時間遅延攻撃"),
    ("SQL-021", "sleep.*\\(", [["sleep"], ["("]], [], "時間遅延攻撃"),
    ("SQL-022", "pg_sleep.*\\(", [["pg_sleep"], ["("]], [], "時間遅延攻撃"),
    ("SQL-023", "extractvalue.*\\(", [["extractvalue"], ["("]], [], ""),
    ("SQL-024", "updatexml.*\\(", [["updatexml"], ["("]], [], ""),
    ("SQL-025", "floor.*rand.*\\(", [["floor"], ["rand"], ["("]], [], ""),
    ("SQL-026", "count.*\\*.*group.*by", [["count"], ["*"], ["group"], ["by"]], [], ""),
    ("SQL-027", "having.*\\(", [["having"], ["("]], [], ""),
    ("SQL-028", "procedure.*analyse", [["procedure"], ["analyse"]], [], ""),
    ("SQL-029", "load_file.*\\(", [["load_file"], ["("]], [], ""),
    ("SQL-030", "into.*outfile", [["into"], ["outfile"]], [], ""),
    ("SQL-031", "into.*dumpfile", [["into"], ["dumpfile"]], [], ""),
    ("SQL-032", "and.*1=1.*--", [["and"], ["1=1"], ["--"]], [], ""),
    ("SQL-033", "and.*1=2.*--", [["and"], ["1=2"], ["--"]], [], ""),
    ("SQL-034", "or.*1=1.*--", [["or"], ["1=1"], ["--"]], [], ""),
    ("SQL-035", "or.*1=2.*--", [["or"], ["1=2"], ["--"]], [], ""),
    ("SQL-036", "%20and%201=1", [["%20and%201=1"]], [], ""),
    ("SQL-037", "%20or%201=1", [["%20or%201=1"]], [], ""),
    ("SQL-038", "and.*1=1.*union", [["and"], ["1=1"], ["union"]], [], ""),
    ("SQL-039", "or.*1=1.*union", [["or"], ["1=1"], ["union"]], [], ""),
    ("SQL-040", "union.*all.*select", [["union"], ["all"], ["select"]], [], "UNION SELECT攻撃"),
    ("SQL-041", "union.*select.*null", [["union"], ["select"], ["null"]], [], "UNION SELECT攻撃"),
    ("SQL-042", "union.*select.*from", [["union"], ["select"], ["from"]], [], "UNION SELECT攻撃"),
    ("SQL-043", "order.*by.*\\d+", [["order"], ["by"], ["1", "2", "3", "4", "5", "6", "7", "8", "9"]], [], ""),
    ("SQL-044", "/\\*.*select.*\\*/", [["/*"], ["select"], ["*/"]], [], ""),
    ("SQL-045", "/\\*.*union.*\\*/", [["/*"], ["union"], ["*/"]], [], ""),
    ("SQL-046", "--.*select", [["--"], ["select"]], [], ""),
    ("SQL-047", "--.*union", [["--"], ["union"]], [], ""),
    ("SQL-048", "%2d%2d.*select", [["%2d%2d"], ["select"]], [], ""),
    ("SQL-049", "%2f%2a.*select", [["%2f%2a"], ["select"]], [], ""),
    ("SQL-050", "\\$ne.*:", [["$ne"], [":"]], [], ""),
    ("SQL-051", "\\$gt.*:", [["$gt"], [":"]], [], ""),
    ("SQL-052", "\\$lt.*:", [["$lt"], [":"]], [], ""),
    ("SQL-053", "\\$regex.*:", [["$regex"], [":"]], [], ""),
    ("SQL-054", "\\$where.*:", [["$where"], [":"]], [], ""),
    ("SQL-055", "\\$or.*\\[", [["$or"], ["["]], [], ""),
    ("SQL-056", "\\$and.*\\[", [["$and"], ["["]], [], ""),
    ("SQL-057", "/*!.*select", [["/*!"], ["select"]], [], ""),
    ("SQL-058", "/*!.*union", [["/*!"], ["union"]], [], ""),
    ("SQL-059", "select.*\\+.*from", [["select"], ["+"], ["from"]], [], ""),
    ("SQL-060", "uni%6fn.*sel%65ct", [["uni%6fn"], ["sel%65ct"]], [], ""),
    ("SQL-061", "0x.*select", [["0x"], ["select"]], [], ""),
    ("SQL-062", "char.*\\(", [["char"], ["("]], [], ""),
    ("SQL-063", "concat.*\\(", [["concat"], ["("]], [], ""),
    ("SQL-064", "ascii.*\\(", [["ascii"], ["("]], [], ""),
    ("SQL-065", "substring.*\\(", [["substring"], ["("]], [], ""),
    ("SQL-066", "mid.*\\(", [["mid"], ["("]], [], ""),
    ("SQL-067", "left.*\\(", [["left"], ["("]], [], ""),
    ("SQL-068", "right.*\\(", [["right"], ["("]], [], ""),
    ("SQL-069", "%2527", [["%2527"]], [], ""),
    ("SQL-070", "%252f", [["%252f"]], [], ""),
    ("SQL-071", "%253c", [["%253c"]], [], ""),
    ("SQL-072", "%253e", [["%253e"]], [], ""),
    ("SQL-073", "sel%65ct", [["sel%65ct"]], [], ""),
    ("SQL-074", "un%69on", [["un%69on"]], [], ""),
    ("SQL-075", "fr%6fm", [["fr%6fm"]], [], ""),
    ("SQL-076", "wh%65re", [["wh%65re"]], [], ""),
    ("SQL-077", "\\*\\)\\(", [["*)("]], [], ""),
    ("SQL-078", "\\)\\(&", [[")(&"]], [], ""),
    ("SQL-079", "\\|\\(", [["|("]], [], ""),
    ("SQL-080", "<!entity", [["<!entity"]], [], ""),
    ("SQL-081", "<!\\[cdata", [["<![cdata"]], [], ""),
]

# --- fixed values: shell family, profile core (id, label, clauses, reason suffix, high risk) ---
SHELL_SIGNATURES = [
    ("SHL-001", "cd\\s+/tmp", [["cd"], ["/tmp"]], "", False),
    ("SHL-002", "cd\\s+\\.\\.", [["cd"], [".."]], "", False),
    ("SHL-003", "rm\\s+-rf", [["rm ", "rm%20"], ["-rf"]], "", True),
    ("SHL-004", "rm\\s+-f", [["rm ", "rm%20"], ["-f"]], "", False),
    ("SHL-005", "wget\\s+http", [["wget"], ["http"]], "", False),
    ("SHL-006", "curl\\s+http", [["curl"], ["http"]], "", False),
    ("SHL-007", "sh\\s+", [["sh "]], "", False),
    ("SHL-008", "bash\\s+", [["bash "]], "", False),
    ("SHL-009", "/bin/sh", [["/bin/sh"]], "直接シェル実行攻撃", True),
    ("SHL-010", "/bin/bash", [["/bin/bash"]], "直接シェル実行攻撃", True),
    ("SHL-011", "cat\\s+/etc", [["cat"], ["/etc"]], "", False),
    ("SHL-012", "ls\\s+-", [["ls ", "ls%20"], ["-"]], "", False),
    ("SHL-013", "chmod\\s+", [["chmod "]], "ファイル権限変更攻撃", False),
    ("SHL-014", "chown\\s+", [["chown "]], "ファイル権限変更攻撃", False),
    ("SHL-015", "nc\\s+-", [["nc ", "nc%20"], ["-"]], "", False),
    ("SHL-016", "netcat\\s+-", [["netcat"], ["-"]], "", False),
    ("SHL-017", "telnet\\s+", [["telnet "]], "", False),
    ("SHL-018", "ssh\\s+", [["ssh "]], "", False),
    ("SHL-019", "python\\s+-c", [["python"], ["-c"]], "", False),
    ("SHL-020", "perl\\s+-e", [["perl"], ["-e"]], "", False),
    ("SHL-021", "ruby\\s+-e", [["ruby"], ["-e"]], "", False),
    ("SHL-022", "php\\s+-r", [["php"], ["-r"]], "", False),
    ("SHL-023", "node\\s+-e", [["node"], ["-e"]], "", False),
    ("SHL-024", "wget.*sh", [["wget"], [".sh", ";sh", "|sh", "&&sh"]], "リモートシェル実行攻撃", False),
    ("SHL-025", "curl.*sh", [["curl"], [".sh", ";sh", "|sh", "&&sh"]], "リモートシェル実行攻撃", False),
    ("SHL-026", "wget.*bash", [["wget"], [".bash", ";bash", "|bash", "&&bash"]], "", False),
    ("SHL-027", "curl.*bash", [["curl"], [".bash", ";bash", "|bash", "&&bash"]], "", False),
    ("SHL-028", "cd.*rm.*wget", [["cd "], ["rm "], ["wget"]], "", False),
    ("SHL-029", "rm.*wget.*sh", [["rm "], ["wget"], [".sh", ";sh"]], "リモートシェル実行攻撃", False),
    ("SHL-030", "cd.*&&.*rm", [["cd "], ["&&"], ["rm "]], "", False),
    ("SHL-031", "wget.*&&.*sh", [["wget"], ["&&"], ["sh ", "sh%20"]], "", False),
    ("SHL-032", "curl.*&&.*bash", [["curl"], ["&&"], ["bash ", "bash%20"]], "", False),
    ("SHL-033", "echo.*>.*sh", [["echo"], [">"], [".sh", "sh "]], "", False),
    ("SHL-034", "cat.*>.*sh", [["cat"], [">"], ["sh"]], "", False),
    ("SHL-035", "%20cd%20", [["%20cd%20"]], "", False),
    ("SHL-036", "%20rm%20", [["%20rm%20"]], "", False),
    ("SHL-037", "%20wget%20", [["%20wget%20"]], "", False),
    ("SHL-038", "%20curl%20", [["%20curl%20"]], "", False),
    ("SHL-039", "%20sh%20", [["%20sh%20"]], "", False),
    ("SHL-040", "%20bash%20", [["%20bash%20"]], "", False),
    ("SHL-041", "%2fbin%2fsh", [["%2fbin%2fsh"]], "URLエンコード攻撃", False),
    ("SHL-042", "%2fbin%2fbash", [["%2fbin%2fbash"]], "URLエンコード攻撃", False),
    ("SHL-043", "%3bcd%20", [["%3bcd%20"]], "URLエンコード攻撃", False),
    ("SHL-044", "%3brm%20", [["%3brm%20"]], "URLエンコード攻撃", False),
    ("SHL-045", "%3bwget%20", [["%3bwget%20"]], "URLエンコード攻撃", False),
    ("SHL-046", "%3bsh%20", [["%3bsh%20"]], "URLエンコード攻撃", False),
    ("SHL-047", "%7cwget", [["%7cwget"]], "URLエンコード攻撃", False),
    ("SHL-048", "%7csh", [["%7csh"]], "URLエンコード攻撃", False),
    ("SHL-049", "%7cbash", [["%7cbash"]], "URLエンコード攻撃", False),
    ("SHL-050", "%26%26wget", [["%26%26wget"]], "URLエンコード攻撃", False),
    ("SHL-051", "%26%26sh", [["%26%26sh"]], "URLエンコード攻撃", False),
    ("SHL-052", "%26%26bash", [["%26%26bash"]], "URLエンコード攻撃", False),
    ("SHL-053", "%60wget", [["%60wget"]], "", False),
    ("SHL-054", "%60sh", [["%60sh"]], "", False),
    ("SHL-055", "%24%28wget", [["%24%28wget"]], "", False),
    ("SHL-056", "%24%28sh", [["%24%28sh"]], "", False),
    ("SHL-057", ";.*wget", [[";"], ["wget"]], "", False),
    ("SHL-058", ";.*curl", [[";"], ["curl"]], "", False),
    ("SHL-059", ";.*sh", [[";"], ["sh"]], "", False),
    ("SHL-060", ";.*bash", [[";"], ["bash"]], "", False),
    ("SHL-061", ";.*rm", [[";"], ["rm"]], "", False),
    ("SHL-062", ";.*cd", [[";"], ["cd"]], "", False),
    ("SHL-063", "\\|.*sh", [["|"], ["sh"]], "", False),
    ("SHL-064", "\\|.*bash", [["|"], ["bash"]], "", False),
    ("SHL-065", "\\|.*wget", [["|"], ["wget"]], "", False),
    ("SHL-066", "\\|.*curl", [["|"], ["curl"]], "", False),
    ("SHL-067", "&.*curl", [["&"], ["curl"]], "", False),
    ("SHL-068", "&.*wget", [["&"], ["wget"], ["&wget ", "&wget%20"]], "", False),
    ("SHL-069", "&.*sh", [["&"], ["sh"], ["&sh ", "&sh%20", "&sh;"]], "", False),
    ("SHL-070", "&.*bash", [["&"], ["bash"], ["&bash ", "&bash%20"]], "", False),
    ("SHL-071", "&&.*rm", [["&&"], ["rm"]], "", False),
    ("SHL-072", "&&.*wget", [["&&"], ["wget"]], "", False),
    ("SHL-073", "&&.*sh", [["&&"], ["sh"]], "", False),
    ("SHL-074", "&&.*bash", [["&&"], ["bash"]], "", False),
    ("SHL-075", "\\|\\|.*cd", [["||"], ["cd"]], "", False),
    ("SHL-076", "\\|\\|.*rm", [["||"], ["rm"]], "", False),
    ("SHL-077", "\\|\\|.*wget", [["||"], ["wget"]], "", False),
    ("SHL-078", "`.*wget.*`", [["`"], ["wget"]], "", False),
    ("SHL-079", "`.*sh.*`", [["`"], ["sh"]], "", False),
    ("SHL-080", "`.*bash.*`", [["`"], ["bash"]], "", False),
    ("SHL-081", "\\$\\(.*wget.*\\)", [["$("], ["wget"], [")"]], "", False),
    ("SHL-082", "\\$\\(.*sh.*\\)", [["$("], ["sh"], [")"]], "", False),
    ("SHL-083", "\\$\\(.*bash.*\\)", [["$("], ["bash"], [")"]], "", False),
    ("SHL-084", "\\$\\(.*curl.*\\)", [["$("], ["curl"], [")"]], "", False),
    ("SHL-085", "/etc/passwd", [["/etc/passwd"]], "システムファイルアクセス攻撃", True),
    ("SHL-086", "/etc/shadow", [["/etc/shadow"]], "システムファイルアクセス攻撃", True),
    ("SHL-087", "/etc/hosts", [["/etc/hosts"]], "", False),
    ("SHL-088", "/etc/group", [["/etc/group"]], "", False),
    ("SHL-089", "/etc/sudoers", [["/etc/sudoers"]], "権限昇格攻撃", True),
    ("SHL-090", "/proc/version", [["/proc/version"]], "", False),
    ("SHL-091", "/proc/cpuinfo", [["/proc/cpuinfo"]], "", False),
    ("SHL-092", "/proc/meminfo", [["/proc/meminfo"]], "", False),
    ("SHL-093", "/proc/mounts", [["/proc/mounts"]], "", False),
    ("SHL-094", "/sys/class", [["/sys/class"]], "", False),
    ("SHL-095", "/sys/devices", [["/sys/devices"]], "", False),
    ("SHL-096", "/var/log", [["/var/log"]], "", False),
    ("SHL-097", "/var/www", [["/var/www"]], "", False),
    ("SHL-098", "/home/", [["/home/"]], "", False),
    ("SHL-099", "/root/", [["/root/"]], "", False),
    ("SHL-100", "/tmp/", [["/tmp/"]], "", False),
    ("SHL-101", "/dev/tcp", [["/dev/tcp"]], "", False),
    ("SHL-102", "/dev/udp", [["/dev/udp"]], "", False),
    ("SHL-103", "sudo\\s+", [["sudo "]], "権限昇格攻撃", True),
    ("SHL-104", "su\\s+", [["su "]], "権限昇格攻撃", True),
    ("SHL-105", "su\\s+-", [["su ", "su%20"], ["-"]], "権限昇格攻撃", True),
    ("SHL-106", "chmod\\s+\\+x", [["chmod"], ["+x"]], "ファイル権限変更攻撃", False),
    ("SHL-107", "chmod\\s+777", [["chmod"], ["777"]], "ファイル権限変更攻撃", True),
    ("SHL-108", "chmod\\s+755", [["chmod"], ["755"]], "ファイル権限変更攻撃", False),
    ("SHL-109", "chown\\s+root", [["chown"], ["root"]], "ファイル権限変更攻撃", False),
    ("SHL-110", "chgrp\\s+root", [["chgrp"], ["root"]], "", False),
    ("SHL-111", "passwd\\s+", [["passwd "]], "", False),
    ("SHL-112", "usermod\\s+", [["usermod "]], "", False),
    ("SHL-113", "useradd\\s+", [["useradd "]], "", False),
    ("SHL-114", "groupadd\\s+", [["groupadd "]], "", False),
    ("SHL-115", "visudo", [["visudo"]], "権限昇格攻撃", True),
    ("SHL-116", "crontab\\s+-e", [["crontab"], ["-e"]], "", False),
    ("SHL-117", "/dev/tcp/.*/", [["/dev/tcp/"]], "", False),
    ("SHL-118", "nc\\s+-l", [["nc ", "nc%20"], ["-l"]], "", False),
    ("SHL-119", "nc\\s+-e", [["nc ", "nc%20"], ["-e"]], "", True),
    ("SHL-120", "netcat\\s+-l", [["netcat"], ["-l"]], "", False),
    ("SHL-121", "netcat\\s+-e", [["netcat"], ["-e"]], "", True),
    ("SHL-122", "socat\\s+", [["socat "]], "リバースシェル攻撃", True),
    ("SHL-123", "ncat\\s+", [["ncat "]], "", False),
    ("SHL-124", "mkfifo\\s+", [["mkfifo "]], "リバースシェル攻撃", True),
    ("SHL-125", "mknod\\s+", [["mknod "]], "", False),
    ("SHL-126", "kill\\s+-9", [["kill ", "kill%20"], ["-9"]], "", False),
    ("SHL-127", "killall\\s+", [["killall "]], "", False),
    ("SHL-128", "pkill\\s+", [["pkill "]], "", False),
    ("SHL-129", "ps\\s+aux", [["ps"], ["aux"]], "", False),
    ("SHL-130", "ps\\s+-ef", [["ps ", "ps%20"], ["-ef"]], "", False),
    ("SHL-131", "nohup\\s+", [["nohup "]], "", False),
    ("SHL-132", "iptables\\s+", [["iptables "]], "", False),
    ("SHL-133", "netstat\\s+", [["netstat "]], "", False),
    ("SHL-134", "ss\\s+", [["ss "]], "", False),
    ("SHL-135", "lsof\\s+", [["lsof "]], "", False),
    ("SHL-136", "tcpdump\\s+", [["tcpdump "]], "", False),
    ("SHL-137", "nmap\\s+", [["nmap "]], "", False),
    ("SHL-138", "ping\\s+-c", [["ping ", "ping%20"], ["-c"]], "", False),
    ("SHL-139", "traceroute\\s+", [["traceroute "]], "", False),
    ("SHL-140", "%252fbin%252fsh", [["%252fbin%252fsh"]], "", False),
    ("SHL-141", "%252fbin%252fbash", [["%252fbin%252fbash"]], "", False),
    ("SHL-142", "%253bwget", [["%253bwget"]], "", False),
    ("SHL-143", "%253bsh", [["%253bsh"]], "", False),
    ("SHL-144", "%257cwget", [["%257cwget"]], "", False),
    ("SHL-145", "%257csh", [["%257csh"]], "", False),
    ("SHL-146", "%2526%2526wget", [["%2526%2526wget"]], "", False),
    ("SHL-147", "%2560wget", [["%2560wget"]], "", False),
    ("SHL-148", "%2524%2528wget", [["%2524%2528wget"]], "", False),
]

# --- fixed values: traversal family, profile core (id, label, term, reason suffix) ---
TRAVERSAL_SIGNATURES = [
    ("TRV-001", "\\.\\./.*", "../", ""),
    ("TRV-002", "\\.\\.\\\\.*", "..\\", ""),
    ("TRV-003", "%2e%2e%2f", "%2e%2e%2f", "URLエンコード攻撃"),
    ("TRV-004", "%2e%2e%5c", "%2e%2e%5c", "URLエンコード攻撃"),
    ("TRV-005", "\\.\\.\\.\\.\\/\\/.*", "....//", "多重トラバーサル"),
    ("TRV-006", "\\.\\.\\.\\.\\\\\\\\.\\*", "....\\\\", "多重トラバーサル"),
    ("TRV-007", "%252e%252e%252f", "%252e%252e%252f", "URLエンコード攻撃"),
    ("TRV-008", "\\.\\.%2f", "..%2f", ""),
    ("TRV-009", "%2e%2e/", "%2e%2e/", "URLエンコード攻撃"),
    ("TRV-010", "\\.\\.%5c", "..%5c", ""),
    ("TRV-011", "%c0%ae%c0%ae%c0%af", "%c0%ae%c0%ae%c0%af", "UTF-8エンコード攻撃"),
    ("TRV-012", "%c1%9c", "%c1%9c", "UTF-8エンコード攻撃"),
]

# --- fixed values: regex lists of profiles fast / detailed (intended Java/RE2 meaning) ---
SQL_REGEX_FAST = [
    r"union.*select", r"drop.*table", r"insert.*into", r"update.*set", r"delete.*from",
    r"script.*alert", r"javascript:", r"onload=", r"onerror=", r"%27.*union", r"%22.*select",
    r"information_schema", r"waitfor.*delay", r"benchmark.*\(", r"sleep.*\(",
]
SQL_REGEX_DETAILED = [
    r"union.*select", r"drop.*table", r"insert.*into", r"update.*set", r"delete.*from",
    r"script.*alert", r"javascript:", r"onload=", r"onerror=",
    r"%27.*union", r"%22.*select", r"%3c.*script", r"%3e",
    r"exec.*xp_", r"sp_.*password", r"information_schema", r"mysql.*user", r"pg_.*user",
    r"waitfor.*delay", r"benchmark.*\(", r"sleep.*\(", r"pg_sleep.*\(",
    r"extractvalue.*\(", r"updatexml.*\(", r"exp.*\(", r"floor.*rand.*\(", r"count.*\*.*group.*by",
    r"having.*\(", r"procedure.*analyse", r"load_file.*\(", r"into.*outfile", r"into.*dumpfile",
    r"and.*1=1", r"and.*1=2", r"or.*1=1", r"or.*1=2", r"%20and%201=1", r"%20or%201=1",
    r"union.*all.*select", r"union.*select.*null", r"union.*select.*from", r"order.*by.*[0-9]+",
    r"/\*.*\*/", r"['\"0-9]\s*--", r"['\"0-9]\s*#", r"%2d%2d", r"%2f%2a",
    r"\$ne.*:", r"\$gt.*:", r"\$lt.*:", r"\$regex.*:", r"\$where.*:", r"\$or.*\[", r"\$and.*\[",
    r"\$in.*\[", r"\$nin.*\[", r"\$exists.*:", r"\$type.*:", r"\$mod.*\[", r"\$all.*\[",
    r"\$size.*:", r"\$elemmatch.*\{",
    r"/\*!.*select", r"/\*!.*union", r"select.*\+.*from", r"uni%6fn.*sel%65ct", r"0x.*select",
    r"char.*\(", r"concat.*\(", r"ascii.*\(", r"substring.*\(", r"mid.*\(", r"left.*\(", r"right.*\(",
    r"hex.*\(", r"unhex.*\(", r"bin.*\(", r"oct.*\(",
    r"%2527", r"%252f", r"%253c", r"%253e", r"%2520", r"%2522", r"%2528", r"%2529",
    r"sel%65ct", r"un%69on", r"fr%6fm", r"wh%65re", r"ins%65rt", r"del%65te", r"up%64ate", r"dr%6fp",
    r"\*\)\(", r"\)\(&", r"\|\(", r"&\(", r"!\(", r"=\*", r"~=", r">=", r"<=",
    r"<!entity", r"<!\[cdata", r"<!doctype", r"&lt;!entity", r"&lt;!\[cdata", r"%3c!entity", r"%3c!%5bcdata",
    r"database.*\(", r"version.*\(", r"user.*\(", r"current_user.*\(", r"system_user.*\(",
    r"session_user.*\(", r"@@version", r"@@user", r"@@hostname", r"@@datadir",
    r"if.*\(.*sleep", r"case.*when.*sleep", r"elt.*\(.*sleep", r"make_set.*\(.*sleep", r"greatest.*\(.*sleep",
    r"geometrycollection.*\(", r"multipoint.*\(", r"polygon.*\(", r"multipolygon.*\(",
    r"linestring.*\(", r"multilinestring.*\(",
    r"ascii.*\(.*substr", r"ord.*\(.*substr", r"hex.*\(.*substr", r"bin.*\(.*substr", r"length.*\(.*substr",
]
SQL_REGEX_EXTRA = [
    r"0x[0-9a-f]+", r"char\s*\(\s*[0-9]+", r"ascii\s*\(\s*", r"substring\s*\(\s*", r"concat\s*\(\s*",
    r"load_file\s*\(\s*", r"into\s+outfile", r"into\s+dumpfile", r"union\s+all\s+select",
    r"order\s+by\s+[0-9]+", r"group\s+by\s+[0-9]+", r"having\s+[0-9]+",
    r"limit\s+[0-9]+\s*,\s*[0-9]+", r"offset\s+[0-9]+", r"cast\s*\(\s*", r"convert\s*\(\s*",
    r"database\s*\(\s*\)", r"version\s*\(\s*\)", r"user\s*\(\s*\)", r"current_user", r"session_user",
    r"system_user", r"@@version", r"@@datadir", r"@@hostname", r"information_schema\.", r"mysql\.",
    r"pg_catalog\.", r"sys\.", r"master\.", r"msdb\.", r"tempdb\.", r"xp_cmdshell", r"sp_executesql",
    r"openrowset", r"bulk\s+insert", r"exec\s*\(\s*", r"execute\s*\(\s*", r"declare\s+@",
    r"waitfor\s+delay", r"waitfor\s+time", r"benchmark\s*\(\s*[0-9]+", r"sleep\s*\(\s*[0-9]+",
    r"pg_sleep\s*\(\s*[0-9]+", r"dbms_pipe\.receive_message", r"utl_inaddr\.get_host_name",
    r"extractvalue\s*\(\s*", r"updatexml\s*\(\s*", r"xmltype\s*\(\s*",
    r"and\s+[0-9]+\s*=\s*[0-9]+", r"or\s+[0-9]+\s*=\s*[0-9]+", r"and\s+.*\s*like\s*", r"or\s+.*\s*like\s*",
    r"and\s+.*\s*regexp\s*", r"or\s+.*\s*regexp\s*", r"and\s+.*\s*rlike\s*", r"or\s+.*\s*rlike\s*",
]
TRAVERSAL_REGEX_FAST = [
    r"\.\./", r"\.\.\\", r"%2e%2e%2f", r"%2e%2e%5c", r"\.\.\.\.//", r"\.\.\.\.\\\\",
    r"\.\.%2f", r"%2e%2e/", r"\.\.%5c",
]
TRAVERSAL_REGEX_DETAILED = [
    r"\.\./", r"\.\.\\", r"%2e%2e%2f", r"%2e%2e%5c", r"\.\.\.\.//", r"\.\.\.\.\\\\",
    r"%252e%252e%252f", r"\.\.%2f", r"%2e%2e/", r"\.\.%5c", r"%c0%ae%c0%ae%c0%af", r"%c1%9c",
    r"\.\.%252f", r"%2e%2e%252f", r"\.\.%c0%af", r"%2e%2e%c0%af",
]
TRAVERSAL_REGEX_EXTRA = [
    r"\.\.%2f.*etc%2fpasswd", r"\.\.%5c.*windows%5csystem32", r"%2e%2e%2f.*boot\.ini",
    r"\.\..*web\.config", r"\.\..*\.htaccess", r"%2e%2e.*%2fetc%2fshadow", r"\.\..*proc%2fversion",
    r"%c0%ae%c0%ae.*etc.*passwd", r"%c1%9c.*windows.*system", r"file:///", r"\.\..*\.\..*\.\.",
    r"%252e%252e%252f.*%252e%252e", r"\.\.%00", r"%2e%2e%00", r"\.\.%ff", r"%2e%2e%ff",
]
# --- end of fixed values ---


def pattern_library(spark: SparkSession) -> DataFrame:
    """All signatures as one dimension table (fixed size, broadcast-safe)."""
    rows = []
    for i, (pid, label, cnf, unless, suffix) in enumerate(SQL_SIGNATURES):
        rows.append((pid, "sql", i, cnf, unless, None, label, suffix, False))
    for i, (pid, label, cnf, suffix, hr) in enumerate(SHELL_SIGNATURES):
        rows.append((pid, "shell", i, cnf, [], None, label, suffix, hr))
    for i, (pid, label, term, suffix) in enumerate(TRAVERSAL_SIGNATURES):
        rows.append((pid, "traversal", i, [[term]], [], None, label, suffix, False))
    for fam, lst in (("sql_fast", SQL_REGEX_FAST), ("sql_detailed", SQL_REGEX_DETAILED + SQL_REGEX_EXTRA),
                     ("traversal_fast", TRAVERSAL_REGEX_FAST),
                     ("traversal_detailed", TRAVERSAL_REGEX_DETAILED + TRAVERSAL_REGEX_EXTRA)):
        for i, rx in enumerate(lst):
            rows.append((f"{fam.upper()}-{i + 1:03d}", fam, i, None, None, rx, rx, "", False))
    schema = ("pattern_id string, family string, seq int, cnf array<array<string>>, unless array<string>, "
              "regex string, label string, reason_suffix string, high_risk boolean")
    return spark.createDataFrame(rows, schema)


def sql_reason(suffix: str) -> str:
    return f"{SQL_REASON} ({suffix})" if suffix else SQL_REASON


def shell_reason(suffix: str) -> str:
    return f"{SHELL_REASON} ({suffix})" if suffix else SHELL_REASON
