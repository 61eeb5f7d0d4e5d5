"""Rules and other fixed values that results depend on."""

# Rule id, title, severity, CWE, pattern (searched in each line).
LINE_RULES = [
    ("sql-injection", "Potential SQL injection", "HIGH", "CWE-89",
     r"(?i)(executeQuery|executeUpdate|SELECT.{0,120}\+|SELECT.{0,120}\$\{)"),
    ("command-injection", "Potential command injection", "HIGH", "CWE-78",
     r"(?i)(Runtime\.getRuntime\(\)\.exec|ProcessBuilder|os\.system|subprocess\.(run|Popen|call)|child_process\.(exec|execSync))"),
    ("xss", "Potential cross-site scripting sink", "HIGH", "CWE-79",
     r"(?i)(innerHTML\s*=|document\.write\s*\(|dangerouslySetInnerHTML|v-html\s*=)"),
    ("path-traversal", "Potential path traversal", "HIGH", "CWE-22",
     r"(?i)\b(readFile|writeFile|open|FileInputStream|Paths?\.get)\s*\([^)]*(request|params|query|input|filename)"),
    ("weak-crypto", "Weak cryptography", "MEDIUM", "CWE-327", r"(?i)\b(MD5|SHA1|SHA-1|DES|3DES|RC4|ECB)\b"),
    ("tls-disabled", "TLS verification disabled", "HIGH", "CWE-295",
     r"(?i)(verify\s*[:=]\s*false|rejectUnauthorized\s*:\s*false|TrustAll)"),
    ("debug", "Debug mode enabled", "MEDIUM", "CWE-489", r"(?i)(DEBUG\s*=\s*True|debug\s*[:=]\s*true)"),
]

# Rule id, title, severity, CWE, confidence of the configuration checks.
CONFIG_RULES = [
    ("docker-user-root", "Dockerfile runs as root", "HIGH", "CWE-250", "high"),
    ("docker-add-remote", "Docker ADD uses a remote URL", "MEDIUM", "CWE-829", "high"),
    ("docker-pipe-to-shell", "Docker command pipes a download to a shell", "HIGH", "CWE-829", "high"),
    ("docker-secret-in-build", "Dockerfile exposes a secret in ENV or ARG", "HIGH", "CWE-798", "high"),
    ("docker-user-missing", "Dockerfile does not specify a non-root USER", "MEDIUM", "CWE-250", "medium"),
    ("compose-privileged", "Compose service is privileged", "HIGH", "CWE-250", "high"),
    ("compose-host-network", "Compose service uses host networking", "HIGH", "CWE-668", "high"),
    ("compose-docker-socket", "Compose exposes the Docker socket", "HIGH", "CWE-668", "high"),
    ("compose-plaintext-secret", "Compose contains a plaintext secret", "HIGH", "CWE-798", "medium"),
    ("k8s-privileged-container", "Kubernetes container is privileged", "HIGH", "CWE-250", "high"),
    ("k8s-host-network", "Kubernetes pod uses hostNetwork", "HIGH", "CWE-668", "high"),
    ("k8s-host-pid", "Kubernetes pod uses hostPID", "HIGH", "CWE-250", "high"),
    ("k8s-hostpath", "Kubernetes volume uses hostPath", "HIGH", "CWE-668", "high"),
    ("k8s-loadbalancer", "Kubernetes service is externally exposed", "MEDIUM", "CWE-284", "medium"),
    ("k8s-resource-limits-missing", "Kubernetes container has no resource limits", "MEDIUM", "CWE-400", "medium"),
    ("github-action-unpinned", "GitHub Action is not pinned to a commit", "MEDIUM", "CWE-829", "high"),
    ("github-pull-request-target", "Workflow uses pull_request_target", "HIGH", "CWE-74", "medium"),
    ("github-target-checkout", "pull_request_target checks out untrusted code", "HIGH", "CWE-94", "high"),
    ("github-secrets-in-run", "Workflow interpolates a secret in a shell command", "HIGH", "CWE-78", "high"),
]

# File suffixes and directories.
FLOW_SUFFIXES = [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"]
SCAN_SUFFIXES = [
    ".java", ".js", ".jsx", ".ts", ".tsx", ".py", ".php", ".cs", ".go", ".rb", ".rs", ".c", ".cpp", ".h",
    ".yml", ".yaml", ".json", ".xml", ".properties", ".env", ".toml", ".ini", ".txt",
]
SOURCE_SUFFIXES = [
    ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".rb", ".php", ".c", ".cc", ".cpp", ".h", ".hpp",
    ".cs", ".rs", ".kt", ".swift",
]
CONFIG_NAMES = [
    "package.json", "requirements.txt", "pipfile", "pipfile.lock", "poetry.lock", "pyproject.toml", "pom.xml",
    "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", ".env", ".env.example",
]
CONFIG_SUFFIXES = [".yaml", ".yml", ".ini", ".cfg", ".conf"]
SERVICE_TERMS = [
    "listen", "server", "service", "port", "hostnetwork", "loadbalancer", "docker.sock", "localhost", "127.0.0.1",
]
#: Directories whose files are left out; the last is our own state folder.
IGNORED_DIRECTORIES = [".git", "node_modules", "target", "build", "dist", "__pycache__", ".lintlake"]
MAX_BYTES = 2_000_000
MAX_EVIDENCE = 300

# Ordered levels and their weights.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
CONFIDENCES = ["HIGH", "MEDIUM", "LOW"]
SEVERITY_POINTS = {"CRITICAL": 10, "HIGH": 7, "MEDIUM": 4, "LOW": 2, "INFO": 0}
CONFIDENCE_WEIGHTS = {"HIGH": 1.0, "MEDIUM": 0.75, "LOW": 0.5}
WORKFLOW_STATES = ["open", "in-progress", "accepted-risk", "false-positive", "resolved"]
OVERLAP_FAMILIES = [("command", "exec"), ("sql", "query"), ("xss", "html"), ("path", "traversal")]

# Patterns.
SECRET_NAME = r"(?i)(password|passwd|secret|token|api[_-]?key|private[_-]?key|credential)"
PLACEHOLDER = r"(?i)^(?:\$\{?[^}]+\}?|change(?:-me)?|example|placeholder|your[-_].*|redacted)$"
KUBERNETES_KIND = r"(?im)^\s*kind\s*:\s*(?:Deployment|DaemonSet|StatefulSet|Pod|Job|CronJob|Service)\s*$"
REDACT = r"(?i)((?:api[_-]?key|token|secret|password|private[_-]?key)\s*)[:=]\s*[\"']?[^\"'\s,;]+"
SOURCE_TERMS = r"(?i)\b(request|input|query|param|upload|user|source)\b"
SINK_TERMS = r"(?i)\b(exec|command|sql|query|html|innerhtml|deserialize|path|file|sink)\b"
CONFIG_FILES = r"(?i)docker|compose|k8s|kubernetes|workflow|action|\.ya?ml|dockerfile"

#: Advice by rule; ours.
ADVICE = {
    "sql-injection": "Bind parameters instead of building the statement from text.",
    "command-injection": "Call the program without a shell and allow only known arguments.",
    "xss": "Encode for the place of output, or set text instead of markup.",
    "path-traversal": "Resolve the path and require that it stays below a fixed folder.",
    "weak-crypto": "Use an authenticated cipher, or a password hash for passwords.",
    "tls-disabled": "Leave certificate and host name checks on.",
    "debug": "Turn debug mode off in production.",
}
DEFAULT_ADVICE = "Review this finding and apply a fitting fix."
