"""The thirty checks.  Titles, severities and categories are fixed values; the other texts are ours."""

from __future__ import annotations

DATA, SECRETS = "Sensitive Data Exposure", "Secrets Exposure"
CONFIG, GOVERNANCE, ACTIVITY = "Insecure Configuration", "Data Governance", "Suspicious Activity"

# id, severity, category, title, what was seen, what to do
CHECKS = (
    ("DATA-PAN", "critical", DATA, "Payment card number (PAN) stored in cleartext",
     "A number with a valid card check digit stands readable in the data.",
     "Tokenize, truncate or encrypt card numbers where they are kept and mask them where they are shown."),
    ("DATA-SSN", "critical", DATA, "US Social Security Number in cleartext",
     "A number in the form of a US Social Security Number stands readable in the data.",
     "Remove or encrypt the number and keep such files on controlled, encrypted storage."),
    ("DATA-PII-EMAIL", "medium", DATA, "Bulk personal email addresses in scanned file",
     "The file holds several different email addresses, which are personal data.",
     "Check that the addresses may be kept here; otherwise pseudonymize or delete them."),
    ("DATA-PHONE", "low", DATA, "Bulk phone numbers in scanned file",
     "The file holds several different phone numbers, which are personal data.",
     "Check that contact data may be kept here and strip it from logs and short-lived exports."),
    ("DATA-MRN", "high", DATA, "Possible medical record / health identifier",
     "A value labelled as a patient, record or diagnosis identifier stands readable in the data.",
     "Keep health data within the protected environment, encrypt it, and de-identify copies."),
    ("SECRET-PRIVKEY", "critical", SECRETS, "Private key material embedded in file",
     "The header of a PEM private key was found.",
     "Replace the key pair at once and hold keys in a hardware module or secret store."),
    ("SECRET-CLOUD-KEY", "critical", SECRETS, "Cloud / API credential in cleartext",
     "A value has the form of a cloud access key, service token or signed web token.",
     "Rotate the credential, review its recent use and supply it from a secret store at run time."),
    ("SECRET-HIGH-ENTROPY", "high", SECRETS, "High-entropy value assigned to a secret-like key",
     "A key named like a credential holds a value that looks random.",
     "Find out whether the value is live; rotate it if so, otherwise accept it in the baseline."),
    ("SECRET-PASSWORD", "high", SECRETS, "Hard-coded password in cleartext",
     "A password is written out next to its key.",
     "Rotate the password and read it from a secret store or the environment."),
    ("CFG-WEAK-TLS", "high", CONFIG, "Weak TLS/SSL protocol version enabled",
     "A setting allows SSL 2/3 or TLS 1.0/1.1.",
     "Allow TLS 1.2 and later only."),
    ("CFG-WEAK-CIPHER", "high", CONFIG, "Weak cipher or hash algorithm configured",
     "A setting names a broken cipher or hash.",
     "Use authenticated ciphers and SHA-256 or better; drop the old suites."),
    ("CFG-ENCRYPTION-OFF", "critical", CONFIG, "Encryption explicitly disabled",
     "A setting switches encryption off.",
     "Switch encryption on and record any exception with its compensating measures."),
    ("CFG-TLS-VERIFY-OFF", "high", CONFIG, "TLS certificate verification disabled",
     "A setting turns off the check of certificates.",
     "Verify certificates again and repair the trust chain instead."),
    ("CFG-DEBUG", "medium", CONFIG, "Debug / verbose error mode enabled",
     "A setting switches on debug output or detailed errors.",
     "Switch it off in production and keep details in protected logs."),
    ("CFG-DEFAULT-CREDS", "critical", CONFIG, "Default or vendor-supplied credentials in use",
     "A setting holds a well-known default account or password.",
     "Change vendor defaults before going live and disable default accounts."),
    ("CFG-WEAK-PASS-POLICY", "medium", CONFIG, "Weak password policy",
     "A policy setting allows short passwords or unlimited attempts.",
     "Require at least 12 characters, lock out repeated failures and add a second factor."),
    ("CFG-MFA-OFF", "high", CONFIG, "Multi-factor authentication disabled",
     "A setting switches a second factor off.",
     "Require a second factor, best a phishing-resistant one, for remote and administrative access."),
    ("CFG-AUDIT-OFF", "high", CONFIG, "Audit logging disabled or reduced",
     "A setting switches audit or access logs off.",
     "Log sign-ins, privileged actions and data access to a central store that resists tampering."),
    ("CFG-ANON-ACCESS", "high", CONFIG, "Anonymous / guest / public access enabled",
     "A setting lets in anonymous, guest or public users.",
     "Require sign-in and least privilege."),
    ("CFG-CLEARTEXT-PROTO", "high", CONFIG, "Cleartext protocol enabled (Telnet/FTP/HTTP for auth)",
     "A setting enables a protocol without encryption.",
     "Move to its encrypted successor and disable the old service."),
    ("CFG-BIND-ALL", "medium", CONFIG, "Service bound to all interfaces (0.0.0.0 / ::)",
     "A service listens on every network interface.",
     "Bind it to the interface it needs and segment the network."),
    ("CFG-RETENTION", "medium", GOVERNANCE, "Indefinite or excessive data retention configured",
     "A setting keeps data without end or for very long.",
     "Set a retention period per kind of data and delete automatically."),
    ("LOG-BRUTEFORCE", "high", ACTIVITY, "Repeated authentication failures (possible brute force)",
     "One account or source failed to sign in many times.",
     "Look into the source, limit attempts, require a second factor and check the accounts."),
    ("LOG-PRIV-ESC", "medium", ACTIVITY, "Privileged access anomaly in logs",
     "Kept for explicit signs of privilege escalation; routine account changes have their own check.",
     "Compare the events with approved changes and follow up on the rest."),
    ("LOG-CLEARTEXT-USE", "medium", ACTIVITY, "Cleartext protocol usage observed in logs",
     "Log lines show connections without encryption.",
     "Find the clients, move them to encrypted protocols and close the old listeners."),
)

# Checks that share category, remediation and control references with another:
# id, that other check, severity, title, what was seen
DERIVED = (
    ("LOG-PRIV-FAIL", "LOG-PRIV-ESC", "high", "Failed or unauthorized privileged operation",
     "A privileged operation was refused."),
    ("LOG-PRIV-CHANGE", "LOG-PRIV-ESC", "info", "Privileged account or role change observed",
     "An administrative change took place; compare it with approved changes."),
    ("LOG-SPRAY", "LOG-BRUTEFORCE", "high", "Possible password spraying",
     "One source tried several accounts within five minutes."),
    ("LOG-DISTRIBUTED", "LOG-BRUTEFORCE", "high", "Possible distributed account attack",
     "Several sources tried one account within five minutes."),
    ("LOG-FAIL-SUCCESS", "LOG-BRUTEFORCE", "high", "Authentication success after repeated failures",
     "A sign-in succeeded shortly after repeated failures."),
)
