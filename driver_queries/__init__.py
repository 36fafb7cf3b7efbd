"""The library's operators on the driver's tables, each beside the SQL that must agree."""
