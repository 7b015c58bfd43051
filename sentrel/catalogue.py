"""The built-in check catalogue.

Everything in this module is a fixed value: ids, severities, patterns and texts
appear verbatim in findings (``rule``, ``description``, ``remediation``), so they
must stay exactly as they are for findings and ids to compare equal. The patterns
use only syntax that Java regex, RE2 and Python ``re`` share.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """One check: what it looks for and what a finding of it says."""

    check_id: str
    name: str
    agent: str
    kind: str  # regex | ast_or_regex | filename
    rule_id: str
    severity: str | None
    confidence: str | None
    description: str
    remediation: str | None
    patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    filenames: tuple[str, ...] = ()
    code_events: tuple[str, ...] = ()


AGENTS = {
    "secrets": "Secrets & Identity Agent",
    "injection": "Input & Injection Agent",
    "infra": "Infra & Client Agent",
}

DEFAULT_SEVERITY = "medium"
DEFAULT_CONFIDENCE = "medium"
DEFAULT_REMEDIATION = "Review this code path and apply the least-privilege secure alternative."

# Lower is more urgent; anything else ranks UNKNOWN_RANK.
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
UNKNOWN_RANK = 5

# --- Fixed values: the 36 checks, in id order -------------------------------
CHECKS = (
    Rule(
        "01", "DB Credentials", "secrets", "regex", "database-credential-literal", "critical", "high",
        "Database connection strings or credential-shaped values may be embedded in source.",
        "Move database credentials to a managed secret store, rotate exposed values, and use least-privilege accounts.",
        patterns=(
            r"""(?i)(postgres|mysql|mongodb|redis)(?:ql)?://[^\s"']+:[^\s"']+@""",
            r"""(?i)(db[_-]?(password|user|secret)|database_url)\s*[:=]""",
        ),
    ),
    Rule(
        "02", ".env Files", "secrets", "filename", "environment-file-present", "high", "high",
        "Environment files can contain deployable secrets and should not be committed.",
        "Remove secret-bearing environment files from source control, add safe templates, and rotate any exposed values.",
        filenames=(".env", ".env.local", ".env.production", ".env.development"),
    ),
    Rule(
        "03", "Hardcoded Secrets", "secrets", "regex", "hardcoded-secret", "critical", "medium",
        "Credential and API-token patterns should not be hardcoded.",
        "Use runtime-injected secrets, redact them from history, and rotate the affected credential.",
        patterns=(
            r"""(?i)(api[_-]?key|secret[_-]?key|access[_-]?token|client[_-]?secret)\s*[:=]\s*["'][^"']{8,}""",
            r"""\b(?:ghp_|github_pat_|sk_live_|AKIA)[A-Za-z0-9_-]{12,}\b""",
        ),
    ),
    Rule(
        "04", "Weak Auth", "secrets", "regex", "weak-authentication", "high", "medium",
        "Authentication code may accept weak or bypassable credentials.",
        "Use a vetted identity provider or strong password hashing with MFA and explicit failure handling.",
        patterns=(
            r"""(?i)(password|passwd).{0,30}(==|===|equals\s*\().{0,30}["'](?:password|admin|123456|test)["']""",
            r"""(?i)if\s+.*(auth|authenticated|is_admin)\s*:\s*return\s+(true|1)""",
        ),
    ),
    Rule(
        "05", "Missing Authz", "secrets", "regex", "missing-authorization-guard", "high", "low",
        "Sensitive route handlers may lack an authorization guard.",
        "Enforce server-side authorization for every sensitive operation and verify the resource owner.",
        patterns=(
            r"""(?i)(app|router)\.(get|post|put|patch|delete)\s*\([^\n]*(admin|user|account|billing|private)""",
            r"""(?i)@(?:app|router)\.(get|post|put|delete).*?(admin|account|private)""",
        ),
    ),
    Rule(
        "06", "Cross-User Access", "secrets", "regex", "cross-user-access", "high", "low",
        "Object access may be performed without binding the record to the authenticated user.",
        "Constrain every object lookup by the authenticated principal or an explicit policy decision.",
        patterns=(
            r"""(?i)(findById|findOne|select\s+\*|where\s+id\s*=).{0,80}(req\.(params|query)|path\.?id)""",
            r"""(?i)user_id\s*=\s*(req\.(params|query)|body\.)""",
        ),
    ),
    Rule(
        "07", "Open DB Permissions", "secrets", "regex", "open-database-permissions", "high", "medium",
        "Database access configuration may grant broad or anonymous permissions.",
        "Apply least privilege, separate read/write roles, and deny anonymous database access by default.",
        patterns=(
            r"""(?i)(grant\s+all|public\s*=\s*true|allow_anonymous|anonymous_access)""",
            r"""(?i)(read|write|admin).{0,20}(true|\*)""",
        ),
    ),
    Rule(
        "08", "Cloud Misconfiguration", "infra", "regex", "cloud-public-access", "high", "medium",
        "Cloud resources may be configured for public or overly broad access.",
        "Restrict network and storage policies to required principals and private endpoints.",
        patterns=(r"""(?i)(public-read|public-read-write|0\.0\.0\.0/0|allUsers|publicAccess)""",),
    ),
    Rule(
        "09", "Admin Routes", "infra", "regex", "administrative-route", "high", "medium",
        "Administrative endpoints require strong authentication and authorization.",
        "Protect admin routes with centralized authorization, network controls, MFA, and audit logging.",
        patterns=(r"""(?i)(/admin|/administrator|/manage|/internal)""",),
    ),
    Rule(
        "10", "Debug Tools", "infra", "regex", "debug-tool-enabled", "high", "medium",
        "Debug consoles and development switches should not be exposed in production.",
        "Disable debug tooling in production and gate diagnostics behind authenticated, private controls.",
        patterns=(r"""(?i)(debug\s*[:=]\s*true|DEBUG\s*=\s*1|werkzeug\.debug|enable_debug|devtools)""",),
    ),
    Rule(
        "11", "Log Leaks", "secrets", "regex", "sensitive-value-logging", "high", "high",
        "Logs may include passwords, tokens, authorization headers, or personal data.",
        "Log structured event metadata only, redact sensitive fields, and apply retention and access controls.",
        patterns=(
            r"""(?i)(console\.log|logger\.(info|debug|error)|print\s*\().{0,100}(password|token|secret|authorization|cookie|credit[_-]?card)""",
        ),
    ),
    Rule(
        "12", "Verbose Errors", "infra", "regex", "verbose-error-response", "medium", "medium",
        "Error responses may expose stack traces or internal implementation details.",
        "Return stable public error codes and keep traces in protected server logs.",
        patterns=(
            r"""(?i)(send|json|response).{0,30}(stack|stacktrace|traceback|exception)""",
            r"""(?i)(DEBUG|show_errors|include_stack)\s*[:=]\s*true""",
        ),
    ),
    Rule(
        "13", "Git Secrets", "secrets", "regex", "git-secret-artifact", "high", "medium",
        "Git metadata or credential artifacts should not be shipped or committed.",
        "Remove credential artifacts from commits, rotate exposed values, and enforce secret scanning in CI.",
        patterns=(r"""(?i)(\.git/config|git_credentials|\.npmrc|\.pypirc)""",),
    ),
    Rule(
        "14", "JavaScript Secrets", "secrets", "regex", "browser-secret", "critical", "medium",
        "Browser-bundled JavaScript must not contain privileged secrets.",
        "Keep privileged secrets on the server and expose only narrowly scoped public configuration.",
        patterns=(r"""(?i)(api[_-]?key|secret|private[_-]?key|access[_-]?token)\s*[:=]\s*["'][^"']{8,}""",),
    ),
    Rule(
        "15", "Client-only Security", "infra", "regex", "client-only-authorization", "high", "low",
        "Security decisions implemented only in client code can be bypassed.",
        "Repeat all authorization decisions on the server; treat client state as untrusted presentation state.",
        patterns=(
            r"""(?i)(isAdmin|canAccess|hasPermission).{0,40}(localStorage|sessionStorage|window\.)""",
            r"""(?i)if\s*\(.*(isAdmin|authorized).{0,30}\)\s*\{""",
        ),
    ),
    Rule(
        "16", "Input Validation", "injection", "ast_or_regex", "unvalidated-input", "high", "low",
        "Untrusted request data may reach application logic without schema validation.",
        "Validate type, length, format, and allowed values at the trust boundary using a strict schema.",
        patterns=(r"""(?i)(req\.(body|query|params)|request\.(args|form|json)|sys\.argv)""",),
        code_events=("dynamic execution via eval", "dynamic execution via exec"),
    ),
    Rule(
        "17", "SQL Injection", "injection", "ast_or_regex", "sql-string-concatenation", "critical", "high",
        "SQL statements may be assembled from untrusted input.",
        "Use parameterized queries or a safe query builder and validate identifiers separately.",
        patterns=(r"""(?i)(execute|query|raw|sequelize\.query)\s*\([^\n]*(\+|f["']|%\s)""",),
    ),
    Rule(
        "18", "NoSQL Injection", "injection", "regex", "nosql-operator-input", "high", "medium",
        "User-controlled objects may be passed directly into NoSQL selectors.",
        "Allowlist selector fields and operators, reject object-shaped user input where scalar input is expected.",
        patterns=(
            r"""(?i)(find|findOne|updateOne|deleteOne)\s*\([^\n]*(req\.(body|query)|request\.)""",
            r"""(?i)(\$where|\$regex|\$ne|\$gt).{0,40}(req|request|input)""",
        ),
    ),
    Rule(
        "19", "Cross-Site Scripting", "injection", "regex", "unsafe-html-sink", "high", "medium",
        "Untrusted content may be inserted into an HTML or script context.",
        "Use contextual output encoding and safe DOM APIs; sanitize only with a maintained allowlist sanitizer.",
        patterns=(
            r"""(?i)(innerHTML|outerHTML|insertAdjacentHTML|dangerouslySetInnerHTML)\s*=""",
            r"""(?i)(document\.write|\.html\s*\()""",
        ),
    ),
    Rule(
        "20", "CSRF", "injection", "regex", "missing-csrf-signal", "high", "low",
        "State-changing browser requests may lack CSRF protection.",
        "Use SameSite cookies plus framework CSRF tokens or a proven same-origin request defense.",
        patterns=(
            r"""(?i)(app|router)\.(post|put|patch|delete)\s*\(""",
            r"""(?i)fetch\s*\([^\n]*(method\s*:\s*["'](POST|PUT|PATCH|DELETE))""",
        ),
    ),
    Rule(
        "21", "Insecure Uploads", "injection", "regex", "unrestricted-upload", "high", "medium",
        "Uploaded content may be stored or served without type, size, and execution controls.",
        "Allowlist content types, enforce size limits, randomize names, store outside executable paths, and scan content.",
        patterns=(
            r"""(?i)(upload|multipart|file).{0,80}(save|write|copy|move)""",
            r"""(?i)(filename|originalname).{0,40}(path\.join|writeFile|open\s*\()""",
        ),
    ),
    Rule(
        "22", "Path Traversal", "injection", "regex", "untrusted-path", "high", "medium",
        "User-controlled paths may escape the intended directory.",
        "Resolve against a fixed root, verify the resulting path remains within it, and reject traversal segments.",
        patterns=(
            r"""(?i)(readFile|open|sendFile|unlink|path\.join|resolve)\s*\([^\n]*(req\.|request\.|params|query|filename)""",
            r"""(?i)(\.\./|path\.normalize).{0,50}(req|request|input)""",
        ),
    ),
    Rule(
        "23", "SSRF", "injection", "regex", "user-controlled-url-fetch", "high", "medium",
        "Server-side network requests may target attacker-controlled destinations.",
        "Use destination allowlists, block private/link-local ranges after DNS resolution, and restrict redirects.",
        patterns=(
            r"""(?i)(fetch|axios|requests\.(get|post)|urllib\.request|http\.request)\s*\([^\n]*(req\.|request\.|params|query|url)""",
        ),
    ),
    Rule(
        "24", "Password Reset", "secrets", "regex", "weak-password-reset", "high", "medium",
        "Password reset flows may use predictable or reusable tokens.",
        "Use short-lived, single-use, high-entropy reset tokens and avoid account-existence disclosure.",
        patterns=(
            r"""(?i)(reset|password).{0,40}(token|code).{0,40}(timestamp|user_id|random\.random)""",
            r"""(?i)(reset_token|password_reset).{0,50}(==|===).{0,50}(user|email)""",
        ),
    ),
    Rule(
        "25", "Weak Sessions", "secrets", "regex", "weak-session-cookie", "high", "medium",
        "Session cookies or identifiers may lack secure transport and lifecycle settings.",
        "Set Secure, HttpOnly, and appropriate SameSite flags; rotate sessions after authentication and privilege changes.",
        patterns=(
            r"""(?i)(setCookie|cookie).{0,100}(secure\s*:\s*false|httpOnly\s*:\s*false|sameSite\s*:\s*["']none)""",
            r"""(?i)session_secret\s*[:=]\s*["'][^"']{1,15}["']""",
        ),
    ),
    Rule(
        "26", "JWT Secrets", "secrets", "regex", "weak-jwt-signing", "critical", "high",
        "JWT signing may use weak, hardcoded, or algorithm-confusable secrets.",
        "Use managed signing keys, an explicit algorithm allowlist, key rotation, and strict issuer/audience validation.",
        patterns=(
            r"""(?i)(jwt|jsonwebtoken).{0,80}(secret|key).{0,30}["'](?:secret|test|changeme|password)["']""",
            r"""(?i)(algorithm|alg).{0,20}["']none["']""",
        ),
    ),
    Rule(
        "27", "CORS", "infra", "regex", "permissive-cors", "high", "high",
        "Cross-origin policy may allow arbitrary origins with credentials.",
        "Use an explicit origin allowlist and never combine wildcard origins with credentials.",
        patterns=(
            r"""(?i)(Access-Control-Allow-Origin|origin).{0,50}["']\*["']""",
            r"""(?i)(credentials|supports_credentials).{0,20}(true|1)""",
        ),
    ),
    Rule(
        "28", "Rate Limits", "infra", "regex", "missing-rate-limit-signal", "medium", "low",
        "Abuse-sensitive endpoints may lack throttling or lockout controls.",
        "Apply per-IP and per-account limits, exponential backoff, and monitoring to abuse-sensitive operations.",
        patterns=(
            r"""(?i)(login|signin|password|reset|otp|webhook).{0,40}(app|router)\.(post|put)""",
            r"""(?i)(rateLimit|throttle|slowDown)\s*[:=]\s*(false|null)""",
        ),
    ),
    Rule(
        "29", "Exposed Environments", "infra", "regex", "exposed-environment", "high", "medium",
        "Build or runtime environment values may be exposed to untrusted clients.",
        "Expose only intentionally public configuration and keep secret environment variables server-side.",
        patterns=(
            r"""(?i)(window\.__ENV__|window\.env|import\.meta\.env|process\.env).{0,80}(secret|token|password|private|key)""",
        ),
    ),
    Rule(
        "30", "Default Credentials", "secrets", "regex", "default-credential", "critical", "high",
        "Default administrative credentials or example passwords may remain enabled.",
        "Force unique credentials at provisioning and fail closed when defaults are detected.",
        patterns=(
            r"""(?i)(password|passwd|username).{0,30}[:=].{0,10}["'](?:admin|root|password|changeme|123456|test)["']""",
        ),
    ),
    Rule(
        "31", "Unsigned Webhooks", "injection", "regex", "unsigned-webhook", "high", "low",
        "Webhook receivers may process requests without authenticity verification.",
        "Verify provider signatures over the raw body, enforce replay protection, and reject unsigned requests.",
        patterns=(
            r"""(?i)(webhook|callback).{0,100}(req\.body|request\.json|payload)""",
            r"""(?i)(webhook).{0,80}(verify|signature|hmac).{0,20}(false|null|undefined)""",
        ),
    ),
    Rule(
        "32", "Frontend Payment Checks", "infra", "regex", "client-payment-authority", "critical", "medium",
        "Payment authorization or amount decisions must not be trusted from frontend state.",
        "Calculate prices and authorize payment server-side; keep private payment keys out of browser bundles.",
        patterns=(
            r"""(?i)(price|amount|currency|discount).{0,60}(localStorage|sessionStorage|window\.|document\.)""",
            r"""(?i)(stripe|payment|checkout).{0,100}(secret|private|sk_live)""",
        ),
    ),
    Rule(
        "33", "IDOR / BOLA", "injection", "regex", "object-level-authorization", "high", "low",
        "API object identifiers may be accepted without ownership or policy checks.",
        "Authorize access to the specific object using the authenticated principal and tenant boundary.",
        patterns=(
            r"""(?i)(/:id|/\{id\}|params\.id|query\.id).{0,100}(findById|findOne|update|delete)""",
            r"""(?i)(get|put|patch|delete).{0,40}(resource|invoice|order|user).{0,40}id""",
        ),
    ),
    Rule(
        "34", "APIs + Input", "injection", "regex", "api-input-schema", "medium", "low",
        "Public APIs should validate request shape and reject unexpected fields.",
        "Use allowlisted request schemas, reject unknown properties, and validate content type and size.",
        patterns=(
            r"""(?i)(app|router)\.(post|put|patch)\s*\([^\n]*\)""",
            r"""(?i)(req\.body|request\.json|request\.form).{0,40}(insert|create|update|save)""",
        ),
    ),
    Rule(
        "35", "Exposed Logs", "infra", "regex", "public-log-exposure", "high", "medium",
        "Log files, logging endpoints, or log storage may be publicly reachable.",
        "Keep logs in private storage, restrict access, and avoid serving operational files as static assets.",
        patterns=(
            r"""(?i)(/logs?|logfile|access\.log|error\.log)""",
            r"""(?i)(static|public|express\.static).{0,60}(logs?|/var/log)""",
        ),
    ),
    Rule(
        "36", "Source Maps", "infra", "filename", "production-source-map", "medium", "high",
        "Production source maps may reveal proprietary or security-sensitive source.",
        "Keep source maps private or upload them only to protected error-monitoring systems.",
        filenames=(".map", "bundle.js.map", "main.js.map"),
    ),
)
# --- end of fixed values -----------------------------------------------------
