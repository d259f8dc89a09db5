"""Part of the audit-log job library."""
