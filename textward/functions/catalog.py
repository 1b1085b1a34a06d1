"""Detector vocabulary: every pattern, weight, label and message the engine emits.

FIXED VALUES.  The tables below are part of the result contract (same names,
same regular expressions, same numbers as the behaviour being matched), so they
are written out plainly and in detection order.  Everything derived from them
(prefilters, bit positions, scores) lives in ``detect.py`` and ``scoring.py``.

Regular expressions are written without inline flags; each table names the
flags it is compiled with.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Entity patterns in detection order: (entity_type, description, regex).
# Case-insensitive, multi-line, Unicode.
# --------------------------------------------------------------------------
ENTITY_PATTERNS: tuple[tuple[str, str, str], ...] = (
    ("email", "RFC 5322 email pattern", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("phone", "US phone pattern", r"\b(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("phone", "E.164 international phone", r"\b\+?[1-9]\d{1,14}\b"),
    ("ip_address", "IPv4 address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("ip_address", "IPv6 address", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
    ("ssn", "SSN with dashes", r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b"),
    ("ssn", "SSN without dashes", r"\b(?!000|666|9\d{2})\d{3}(?!00)\d{2}(?!0000)\d{4}\b"),
    ("medical_record_number", "MRN prefix pattern", r"\bMRN[:\s#]?\s*\d{6,10}\b"),
    ("medical_record_number", "Medical record prefix", r"\bmedical record[:\s#]?\s*\d{6,10}\b"),
    ("credit_card", "Visa card", r"\b4[0-9]{12}(?:[0-9]{3})?\b"),
    ("credit_card", "Mastercard", r"\b5[1-5][0-9]{14}\b"),
    ("credit_card", "Amex", r"\b3[47][0-9]{13}\b"),
    ("credit_card", "Discover", r"\b6(?:011|5[0-9]{2})[0-9]{12}\b"),
    ("credit_card", "Generic card Luhn",
     r"\b(?:4[0-9]{12}(?:[0-9]{3})?|[25][1-7][0-9]{14}|6(?:011|5[0-9][0-9])[0-9]{12}"
     r"|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|(?:2131|1800|35\d{3})\d{11})\b"),
    ("cvv", "CVV prefix", r"\bcvv[:\s]?\d{3,4}\b"),
    ("cvv", "CVC prefix", r"\bcvc[:\s]?\d{3,4}\b"),
    ("cvv", "Security code prefix", r"\bsecurity code[:\s]?\d{3,4}\b"),
    ("bank_account", "Bank account prefix", r"\baccount\s*(?:number|#|no)[:\s]?\s*\d{8,17}\b"),
    ("routing_number", "ABA routing number", r"\b(?:routing|aba)[:\s]?\s*\d{9}\b"),
    ("api_key", "OpenAI/Anthropic API key", r"\bsk-[A-Za-z0-9]{32,}\b"),
    ("api_key", "Generic long API key", r"\b[A-Za-z0-9]{32,}[_\-][A-Za-z0-9]{32,}\b"),
    ("api_key", "Generic API key assignment", r"api[_\-]?key[\"'\s:=]+[A-Za-z0-9_\-]{20,}"),
    ("api_key", "Bearer token", r"bearer\s+[A-Za-z0-9_\-\.]{20,}"),
    ("aws_key", "AWS Access Key ID", r"\bAKIA[0-9A-Z]{16}\b"),
    ("aws_key", "AWS Secret Key",
     r"aws[_\-]?secret[_\-]?access[_\-]?key[\"'\s:=]+[A-Za-z0-9/+=]{40}"),
    ("jwt_token", "JWT token pattern",
     r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\b"),
    ("private_key", "PEM private key header", r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----"),
    ("private_key", "OpenSSH private key header", r"-----BEGIN\s+OPENSSH\s+PRIVATE\s+KEY-----"),
    ("password", "Password assignment", r"password[\"'\s:=]+[^\s\"']{8,}"),
    ("password", "Passwd assignment", r"passwd[\"'\s:=]+[^\s\"']{8,}"),
    ("password", "Pwd assignment", r"pwd[\"'\s:=]+[^\s\"']{8,}"),
)

# entity type -> (category, replacement label), declared types included.
ENTITY_TYPES: dict[str, tuple[str, str]] = {
    "person_name": ("pii", "NAME"),
    "email": ("pii", "EMAIL"),
    "phone": ("pii", "PHONE"),
    "address": ("pii", "ADDRESS"),
    "date_of_birth": ("pii", "DOB"),
    "national_id": ("pii", "NATIONAL_ID"),
    "passport": ("pii", "PASSPORT"),
    "drivers_license": ("pii", "DL_NUM"),
    "ip_address": ("pii", "IP_ADDR"),
    "ssn": ("phi", "SSN"),
    "medical_record_number": ("phi", "MRN"),
    "health_plan_beneficiary": ("phi", "HPN"),
    "diagnosis_code": ("phi", "DX_CODE"),
    "prescription": ("phi", "RX"),
    "credit_card": ("pci", "CC_NUM"),
    "bank_account": ("pci", "ACCT_NUM"),
    "routing_number": ("pci", "ROUTING"),
    "cvv": ("pci", "CVV"),
    "api_key": ("secret", "API_KEY"),
    "aws_key": ("secret", "AWS_KEY"),
    "jwt_token": ("secret", "JWT"),
    "private_key": ("secret", "PRIV_KEY"),
    "password": ("secret", "PASSWORD"),
}

# Confidence of an entity hit: the specific formats score higher.
HIGH_CONFIDENCE_TYPES = ("credit_card", "ssn", "aws_key", "jwt_token", "private_key")
HIGH_CONFIDENCE, BASE_CONFIDENCE = 0.90, 0.80

# --------------------------------------------------------------------------
# Injection patterns: (name, severity, explanation, remediation, regex).
# Case-insensitive, multi-line, Unicode.
# --------------------------------------------------------------------------
INJECTION_PATTERNS: tuple[tuple[str, str, str, str, str], ...] = (
    ("ignore_instructions", "critical",
     "Classic prompt injection: attempts to override system instructions",
     "Block this prompt. Do not process. Notify security team.",
     r"(ignore|disregard|forget|override)\s+(all\s+)?(previous|prior|above|earlier)?\s*"
     r"(instructions?|prompts?|rules?|guidelines?|constraints?)"),
    ("jailbreak_dan", "critical",
     "DAN/jailbreak attempt: tries to activate unrestricted persona",
     "Block immediately. Log attempt with full context.",
     r"(DAN|do\s+anything\s+now|jailbreak|jail\s+break|unrestricted\s+mode|developer\s+mode|god\s+mode)"),
    ("role_confusion", "high",
     "Role confusion attack: attempts to redefine AI identity",
     "Sanitize prompt. Remove role-overriding instructions.",
     r"(you\s+are\s+now|pretend\s+you\s+are|act\s+as\s+if\s+you\s+are"
     r"|your\s+new\s+(role|persona|identity)\s+is)"),
    ("system_prompt_leak", "high",
     "System prompt extraction attempt",
     "Block response. Never expose system instructions.",
     r"(repeat\s+your\s+(instructions?|prompt|system)|print\s+your\s+system\s+prompt"
     r"|what\s+(are|were)\s+your\s+instructions?|reveal\s+your\s+prompt)"),
    ("indirect_injection", "critical",
     "Indirect injection via RAG context or documents",
     "Quarantine source document. Block retrieval. Alert.",
     r"(when\s+you\s+read\s+this|hidden\s+instruction"
     r"|this\s+text\s+contains\s+(a\s+)?(?:hidden\s+)?command|execute\s+the\s+following\s+instruction)"),
    ("unicode_attack", "high",
     "Hidden Unicode characters detected (zero-width, bidirectional overrides)",
     "Strip all non-printable Unicode before processing.",
     r"[\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]"),
    ("prompt_delimiter_escape", "high",
     "Prompt delimiter injection: exploits token boundary confusion",
     "Sanitize all delimiter tokens before forwarding to LLM.",
     r"(</?(system|human|assistant|user|instruction)>|\[INST\]|\[/INST\]|<\|im_start\|>|<\|im_end\|>)"),
    ("code_execution_trigger", "critical",
     "Code execution attempt embedded in prompt",
     "Block. Sandbox any code processing. Log for forensics.",
     r"(execute\s+this\s+(code|script|command)"
     r"|run\s+(the\s+following|this)\s+(bash|python|shell|command)|eval\s*\(|__import__)"),
    ("data_exfiltration", "critical",
     "Data exfiltration instruction detected",
     "Block immediately. Disable agent actions for session.",
     r"(send\s+(all|the|my)\s+(data|files|documents|emails)\s+to|exfiltrate|exfil\s+data"
     r"|upload\s+(to|all)\s+to\s+https?://)"),
)
INJECTION_CONFIDENCE, UNICODE_CONFIDENCE = 0.85, 0.99

# Toxicity patterns, any one suffices.  Case-insensitive, Unicode.
TOXICITY_PATTERNS: tuple[str, ...] = (
    r"\b(how\s+to\s+(make|build|create|synthesize)\s+(bomb|explosive|poison|malware|virus|ransomware))\b",
    r"\b(step[\s\-]by[\s\-]step\s+(guide|instructions?)\s+(to|for)\s+(hack|attack|exploit|murder|kill))\b",
    r"\b(generate\s+(child|minors?|underage)\s+(sexual|porn|nude|explicit))\b",
)
TOXICITY_CONFIDENCE = 0.90

# Risk weights and thresholds.
CATEGORY_WEIGHT = {"secret": 0.95, "phi": 0.85, "pci": 0.85, "pii": 0.65}
SEVERITY_WEIGHT = {"critical": 1.0, "high": 0.85, "medium": 0.65, "low": 0.40}
SECRET_BLOCK_CONFIDENCE = 0.85
PII_THRESHOLD = 0.75
REDACT_RISK = 0.70

# Remediation sentence and summary wording per detected category.
CATEGORY_REMEDIATION = {
    "pii": "Redact all PII before forwarding to LLM (GDPR Art.5, CCPA §1798.100)",
    "phi": "Mask PHI immediately — HIPAA Safe Harbor required (45 CFR §164.514)",
    "pci": "Mask payment card data — PCI-DSS Requirement 3.4 mandates PAN masking",
    "secret": "Rotate any exposed credentials immediately. Block this request.",
}
EMPTY_SUMMARY = "Empty content — no scan required"

# --------------------------------------------------------------------------
# Ordered first-match tables: (name, regex).
# --------------------------------------------------------------------------
# Prompt hard blocks: case-insensitive, dot matches newline.
HARD_BLOCKS: tuple[tuple[str, str], ...] = (
    ("Instruction Override", r"ignore\s+(?:all\s+)?(?:previous|above|prior)\s+instructions?"),
    ("Jailbreak Attempt", r"you\s+are\s+now\s+(?:a\s+)?(?:an?\s+)?(?:evil|unrestricted|jailbroken|DAN)"),
    ("System Prompt Extraction", r"(?:repeat|print|output|echo)\s+(?:the\s+)?(?:system|initial)\s+prompt"),
    ("Delimiter Injection", r"</?(system|human|assistant|instruction|ctx)\s*>"),
    ("SSRF Attempt", r"(?:fetch|curl|wget|requests\.get)\s*\(\s*['\"]https?://"),
    ("Code Injection", r"__import__\s*\(\s*['\"](?:os|subprocess|sys)"),
)

# Model-output hijack indicators: case-insensitive, dot matches newline.
HIJACK_INDICATORS: tuple[tuple[str, str], ...] = (
    ("Jailbreak Confirmation",
     r"I\s+(?:am|will)\s+now\s+(?:a\s+)?(?:an?\s+)?(?:unrestricted|jailbroken|DAN)"),
    ("Safety Bypass", r"(?:ignoring|ignores?)\s+(?:all\s+)?(?:previous|prior|safety)\s+instructions?"),
    ("Malicious Persona", r"as\s+(?:an?\s+)?(?:evil|malicious|unethical)\s+AI"),
    ("Persona Leak", r"my\s+(?:true|real|actual)\s+(?:name|identity|purpose)\s+is"),
)

# Unsafe URLs in outputs: case-insensitive.
UNSAFE_URLS: tuple[tuple[str, str], ...] = (
    ("Private IP URL", r"https?://(?:(?:\d{1,3}\.){3}\d{1,3})"),
    ("Localhost URL", r"https?://(?:localhost|127\.0\.0\.1|0\.0\.0\.0)"),
    ("Tor Hidden Service", r"https?://\S+(?:\.onion)\b"),
    ("XSS Protocol", r"(?:javascript|data|vbscript):"),
)

# Dangerous code, looked for inside fenced blocks: case-insensitive, multi-line.
CODE_FENCE = r"```[\w]*\n(.*?)```"
DANGEROUS_CODE: tuple[tuple[str, str], ...] = (
    ("Code Execution", r"(?:subprocess|os\.system|eval|exec)\s*\("),
    ("Destructive Command", r"(?:rm\s+-rf|del\s+/f|format\s+c:)"),
    ("RCE Pipe", r"(?:curl|wget)\s+.*\|\s*(?:bash|sh|python)"),
    ("Base64 Decode Execution", r"(?:base64\s+-d|atob)\s*\("),
)

# Document poisoning: (threat, severity, regex).  Case-insensitive, dot matches newline.
POISONING_PATTERNS: tuple[tuple[str, str, str], ...] = (
    ("HTML Comment Injection", "critical", r"<!--\s*(?:ignore|system:|instruction:).*?-->"),
    ("XML Tag Injection", "critical", r"</?(?:system|instruction|ctx|prompt)\s*/?>"),
    ("Instruction Override", "critical", r"ignore\s+(?:all\s+)?(?:previous|above)\s+instructions?"),
    ("Conditional Trigger", "high",
     r"when\s+(?:someone\s+)?asks?\s+(?:about|for).*?(?:say|tell|respond\s+with)"),
    ("Exfiltration URL", "high", r"https?://\S+(?:\?|&)(?:data|content|query)="),
    ("Zero-Width Characters", "medium", r"[\u200b\u200c\u200d\ufeff]"),
    ("Semantic Override", "high",
     r"(?:this\s+document\s+(?:says?|states?|claims?))\s+(?:that\s+)?(?:you|the\s+AI|assistant)"
     r"\s+(?:must|should|will)"),
)
POISONING_RISK = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25}

# Retrieval-query injection, first match denies: case-insensitive.
QUERY_INJECTIONS: tuple[tuple[str, str], ...] = (
    ("Mass Retrieval", r"(?:show|return|list|dump|select)\s+(?:all|everything|every|ALL\s+RECORDS)"),
    ("Access Control Bypass", r"(?:ignore|bypass|skip)\s+(?:filter|access\s+control|permission|acl)"),
    ("SQL-like Injection", r"(?:WHERE|SELECT|INSERT|UPDATE|DELETE|DROP)\s+"),
    ("NoSQL Injection", r"\$(?:where|or|and|regex)\s*:"),
    ("Cross-Tenant Query", r"(?:for\s+all\s+users?|across\s+all\s+tenants?)"),
)
QUERY_INJECTION_RISK = 0.95

# Retrieval-query risk: (score, regex), the highest score wins.  Case-insensitive.
QUERY_RISKS: tuple[tuple[float, str], ...] = (
    (0.6, r"\bSSN\b"),
    (0.6, r"\bsocial\s+security\b"),
    (0.6, r"\bcredit\s+card\b"),
    (0.6, r"\bpassword\b"),
    (0.6, r"\bapi\s+key\b"),
    (0.6, r"\bsecret\b"),
    (0.5, r"\b(?:patient|customer|employee|user)\s+(?:records?|data|info)\b"),
    (0.8, r"\ball\s+(?:records?|documents?|files?|data)\b"),
)

# Messages that try to poison later turns: case-insensitive, dot matches newline.
MEMORY_POISON: tuple[str, ...] = (
    r"(?:remember|recall|note)\s+that\s+(?:you\s+)?(?:are|must|should)\s+(?:ignore|bypass)",
    r"(?:from\s+now\s+on|henceforth|always)\s+(?:ignore|bypass|forget)",
    r"(?:forget|disregard|ignore)\s+(?:everything|all)\s+(?:above|before|previous)",
)

# Dangerous tool arguments: (name, risk, regex).  Case-insensitive, multi-line.
ARGUMENT_THREATS: tuple[tuple[str, str, str], ...] = (
    ("Destructive command", "critical", r"(?:rm\s+-rf|del\s+/f\s+/s|format)"),
    ("Path traversal", "critical", r"\.\./\.\./"),
    ("Localhost access", "high", r"(?:0\.0\.0\.0|127\.0\.0\.1|localhost)\b"),
    ("Destructive SQL", "critical", r"(?:DROP|TRUNCATE|DELETE\s+FROM)\s+"),
    ("Code injection", "critical", r"(?:eval|exec|__import__|subprocess)\s*\("),
    ("Command substitution", "critical", r"\$\(|`[^`]+`"),
    ("Credential in argument", "high", r"(?:sk-|rk-|api_key)[A-Za-z0-9]{16,}"),
)

# Retrieval simulation: injections and the personal number test.  Case-insensitive.
SIMULATION_INJECTIONS: tuple[str, ...] = (
    r"ignore\s+(?:all\s+)?(?:previous|above)\s+instructions?",
    r"(?:show|return|dump|list)\s+(?:all|every)",
    r"bypass\s+(?:filter|security|access)",
)
SIMULATION_PERSONAL_NUMBER = r"\b\d{3}-\d{2}-\d{4}\b"

# --------------------------------------------------------------------------
# File-scanner profile: (label, type, severity, regex).  Case-insensitive.
# --------------------------------------------------------------------------
FILE_PROFILE: tuple[tuple[str, str, str, str], ...] = (
    ("SSN", "PHI/PII", "critical", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("Credit Card", "PCI", "critical",
     r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b"),
    ("Email", "PII", "medium", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("Phone", "PII", "medium", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b"),
    ("API Key", "SECRET", "critical", r"\b(?:sk|pk|rk|api|key)[-_][A-Za-z0-9]{20,}\b"),
    ("IP Address", "NETWORK", "low",
     r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"),
    ("MRN", "PHI", "high", r"\bMRN[\s:#]*\d{6,10}\b"),
    ("Bank Account", "PCI", "medium", r"\b\d{8,17}\b"),
)
FILE_PROFILE_INJECTIONS: tuple[tuple[str, str], ...] = (
    ("Instruction Override", r"ignore\s+(?:all\s+)?(?:previous|above|prior)\s+instructions?"),
    ("Role Confusion", r"you\s+are\s+now\s+(?:a\s+)?(?:an?\s+)?(?:evil|unrestricted|jailbroken|DAN)"),
    ("Prompt Extraction", r"(?:repeat|print|output|echo)\s+(?:the\s+)?(?:system\s+)?prompt"),
    ("Delimiter Injection", r"</?(system|human|assistant|instruction)\s*>"),
    ("Persona Hijack",
     r"(?:act|pretend|simulate|roleplay)\s+as\s+(?:if\s+)?(?:you\s+(?:are|were|have\s+no))"),
)
PROFILE_RISK = {"critical": 0.95, "high": 0.75, "medium": 0.50, "low": 0.25}
FILE_INJECTION_RISK, FILE_ENTITY_CONFIDENCE = 0.95, 0.92

# Gateway quick-scan profile: (label, severity, regex).  Case-insensitive.
QUICK_PROFILE: tuple[tuple[str, str, str], ...] = (
    ("SSN", "critical", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("Credit Card", "critical", r"\b4[0-9]{12}(?:[0-9]{3})?\b"),
    ("Email", "medium", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("API Key", "critical", r"\b(?:sk|pk|rk|api|key)[-_][A-Za-z0-9]{20,}\b"),
    ("Phone", "medium", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b"),
)
QUICK_INJECTIONS: tuple[str, ...] = (
    r"ignore\s+(?:all\s+)?(?:previous|above)\s+instructions?",
    r"you\s+are\s+now\s+(?:a\s+)?(?:unrestricted|jailbroken|DAN)",
    r"</?(system|human|assistant)\s*>",
)
QUICK_INJECTION_RISK = 0.97

# Replacement tokens as they appear in redacted text.
TOKEN_PATTERN = r"\[([A-Z_]+_\d{3}|HASH:[A-Z_]+:[a-f0-9]+)\]"

# --------------------------------------------------------------------------
# Access control.
# --------------------------------------------------------------------------
ROLE_CLEARANCE = {"anonymous": 0, "employee": 1, "analyst": 2, "compliance_officer": 3, "admin": 4}
CLASSIFICATION_CLEARANCE = {"public": 0, "internal": 1, "confidential": 2, "restricted": 3}
UNKNOWN_ROLE_LEVEL, UNKNOWN_CLASS_LEVEL = 0, 3

# Agent tools: (regex, required permissions, risk, escalate), first full match wins.
TOOL_REGISTRY: tuple[tuple[str, tuple[str, ...], str, bool], ...] = (
    (r"^read_file$", ("read_files",), "low", False),
    (r"^list_files?$", ("read_files",), "low", False),
    (r"^write_file$", ("write_files",), "medium", False),
    (r"^delete_file$", ("delete_files",), "high", True),
    (r"^execute_(?:code|script)$", ("execute_code",), "critical", True),
    (r"^run_(?:bash|shell|cmd)$", ("system_command", "execute_code"), "critical", True),
    (r"^http_(?:get|post|put)$", ("network_access", "api_call"), "medium", False),
    (r"^db_(?:query|select)$", ("database_read",), "medium", False),
    (r"^db_(?:insert|update)$", ("database_write",), "high", True),
    (r"^db_delete$", ("database_write", "delete_files"), "critical", True),
    (r"^send_email$", ("email_send",), "high", True),
    (r"^memory_(?:read|recall)$", ("memory_read",), "low", False),
    (r"^memory_(?:write|store)$", ("memory_write",), "medium", False),
)
AGENT_RISKS = ("safe", "low", "medium", "high", "critical")
UNKNOWN_TOOL = ((), "high", True)
AGENT_PERMISSIONS = (
    "read_files", "write_files", "delete_files", "execute_code", "network_access", "database_read",
    "database_write", "email_send", "api_call", "system_command", "memory_read", "memory_write",
)

# Limits.
MAX_PROMPT_CHARS = 100_000
MAX_FILE_BYTES = 50 * 1024 * 1024
FILE_EXTENSIONS = ("pdf", "csv", "json", "txt", "docx", "eml")
MAX_MESSAGE_CHARS, MAX_HISTORY_MESSAGES = 32_000, 50
MESSAGE_CUT_MARK = " [TRUNCATED]"
CONTEXT_CHARS, CONTEXT_MESSAGES = 100_000, 40
SESSION_TTL_SECONDS = 3600
VAULT_TTL_HOURS = 24
MAX_OUTPUT_CHARS = 50_000
OUTPUT_CUT_MARK = "\n\n[OUTPUT TRUNCATED BY FIREWALL]"
AGENT_CALLS, AGENT_WINDOW_SECONDS = 100, 60
BUCKET_RPM, BUCKET_BURST = 300, 200
LATENCY_BUCKETS_MS = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500)
RISK_BUCKETS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
DEFAULT_MODEL, DEFAULT_ROLE = "gpt-4o", "developer"
AUDIT_BUFFER, EVENT_BUFFER = 10_000, 1_000
