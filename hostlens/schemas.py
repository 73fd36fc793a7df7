"""Explicit schemas and the fixed vocabulary of the telemetry domain."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: names, sets and orders that define the results -------------------------------------

FEATURES = [
    "lifetime_seconds", "events_per_second", "seq_length", "unique_syscalls", "uid_is_root", "uid_changed",
    "euid_root", "max_uid_euid_delta", "is_suid_exec", "auid_euid_mismatch", "ephemeral_privileged",
    "failed_call_rate", "failed_call_count", "priv_op_count", "exec_count", "file_access_count",
    "network_count", "shell_from_service", "sensitive_path_access", "parent_child_rarity",
]
BINARY_FEATURES = [
    "uid_is_root", "uid_changed", "euid_root", "is_suid_exec", "auid_euid_mismatch", "ephemeral_privileged",
    "shell_from_service", "sensitive_path_access",
]
# features by importance as judged by an analyst, most important first
DOMAIN_ORDER = [
    "is_suid_exec", "auid_euid_mismatch", "max_uid_euid_delta", "priv_op_count", "exec_count",
    "sensitive_path_access", "shell_from_service", "parent_child_rarity", "ephemeral_privileged",
    "events_per_second", "failed_call_rate", "euid_root", "uid_is_root", "uid_changed", "failed_call_count",
    "file_access_count", "network_count", "unique_syscalls", "seq_length", "lifetime_seconds",
]
PARTIAL_FEATURES = ["is_suid_exec", "ephemeral_privileged", "parent_child_rarity"]  # absent in the second dataset

SKIP_KEY_TAGS = ["auditlog", "(null)", "user_commands", "watch_home"]
SKIP_RECORD_TYPES = ["PROCTITLE"]
UNSET_AUID = 4294967295

SHELL_NAMES = ["bash", "sh", "dash", "zsh", "fish", "csh", "tcsh"]
SERVICE_NAMES = [
    "apache2", "nginx", "vsftpd", "sshd", "mysqld", "postgres", "php-fpm", "httpd", "www-data", "apache", "tomcat",
]
SENSITIVE_PREFIXES = ["/etc/shadow", "/etc/passwd", "/etc/sudoers", "/root/", "/.ssh/authorized_keys", "/proc/mem"]
PRIV_CALLS = [
    "setuid", "setgid", "setreuid", "setregid", "setresuid", "setresgid", "capset", "ptrace", "chown", "fchown",
    "lchown", "fchownat", "chmod", "fchmod", "fchmodat",
]
EXEC_CALLS = ["execve", "execveat"]
FILE_CALLS = [
    "openat", "open", "creat", "rename", "renameat", "unlink", "unlinkat", "mkdir", "mkdirat", "rmdir", "link", "symlink",
]
NET_CALLS = ["connect", "bind", "accept", "accept4", "socket"]

IDENTIFIER_TOKENS = ["ip", "mac", "timestamp", "ts", "host", "hostid", "hostname", "srcip", "dstip", "macaddr"]

FEATURE_GLOSS = {
    "lifetime_seconds": "process wall-clock lifetime",
    "events_per_second": "syscall throughput",
    "seq_length": "length of the syscall sequence",
    "unique_syscalls": "distinct syscall types used",
    "uid_is_root": "process real UID is root",
    "uid_changed": "UID changed during the process lifetime",
    "euid_root": "effective UID is root",
    "max_uid_euid_delta": "largest gap between real and effective UID; large = privilege transition",
    "is_suid_exec": "executed a setuid/setgid binary",
    "auid_euid_mismatch": "audit (login) UID differs from effective UID; identity inconsistency",
    "ephemeral_privileged": "short-lived process that held privilege",
    "failed_call_rate": "fraction of syscalls that returned an error",
    "failed_call_count": "absolute count of failed syscalls",
    "priv_op_count": "count of privileged operations (setuid, capset, ...)",
    "exec_count": "number of exec() calls",
    "file_access_count": "file-access syscalls",
    "network_count": "network-related syscalls",
    "shell_from_service": "a shell was spawned from a service/daemon context",
    "sensitive_path_access": "touched a sensitive path (/etc/shadow, /etc/sudoers, ...)",
    "parent_child_rarity": "rarity of this parent->child exec pair (1 = never seen before)",
}

# phrases of a case's description
CASE_HEAD = "=== RECORD UNDER REVIEW ==="
CASE_VOTES = "Model votes:  XGBoost -> %s (p_malicious=%s)   |   CNN -> %s (p_malicious=%s)"
CASE_TITLE = "Behavioural features, top %d most unusual vs benign (value | pctile vs benign pop | pctile vs attack pop | meaning)"
CASE_ORDER = "Most-deviating features, in order (first = most extreme):"

MAX_SEQUENCE = 50
TOKEN_WIDTH = 7
MIN_EVENTS = 2
MAX_FPR = 0.05
CV_SEED = 42
BAND_LOW, BAND_HIGH = 0.3, 0.7

# --- end of fixed values ------------------------------------------------------------------------------



_EVENT_COLUMNS = (
    "record_type string, timestamp double, seq_id bigint, pid bigint, ppid bigint, uid bigint, euid bigint, "
    "gid bigint, auid bigint, comm string, exe string, name string, acct string, res string, "
    "syscall_name string, key_tag string, success boolean, failed int, source string, scenario string, "
    "host string, label int, technique string, file string, line_no bigint"
)
_BIGINT_FEATURES = [
    "seq_length", "unique_syscalls", "failed_call_count", "priv_op_count", "exec_count", "file_access_count", "network_count",
]


def _feature_type(name: str) -> str:
    if name in BINARY_FEATURES:
        return "int"
    return "bigint" if name in _BIGINT_FEATURES else "double"


def event_schema() -> T.StructType:
    return T.StructType.fromDDL(_EVENT_COLUMNS)


def feature_schema(features: list[str] = FEATURES, label: str = "label") -> T.StructType:
    cols = [f"{f} {_feature_type(f)}" for f in features]
    return T.StructType.fromDDL(", ".join([*cols, f"{label} int", "source string", "technique string", "proc_name string"]))


def oof_schema(features: list[str], models: list[str]) -> T.StructType:
    cols = ["row_id string", *[f"{f} double" for f in features], "fold int", "true_label int", "technique string"]
    for m in models:
        cols += [f"pred_{m} int", f"proba_{m} double"]
    return T.StructType.fromDDL(", ".join(cols))


ARBITRATION = (
    "row_id string, fold int, true_label int, technique string, pred_xgb int, pred_cnn int, proba_xgb double, "
    "proba_cnn double, disagreement_direction string, llm_verdict string, llm_pred int, llm_confidence double, "
    "llm_agrees_with string, parse_status string, rationale_steps string, key_features string, raw string"
)


def arbitration_schema() -> T.StructType:
    return T.StructType.fromDDL(ARBITRATION)


REPLY_JSON = "verdict string, confidence double, rationale_steps array<string>, key_features array<string>, agrees_with string"
REPLY_KEYS = ["verdict", "confidence", "rationale_steps", "key_features", "agrees_with"]
