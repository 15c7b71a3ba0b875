"""Readers of captures, scans, package lists, inventories and feeds; what they refuse comes back as a second table."""
