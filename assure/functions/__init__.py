"""Column builders: integer money, dates in IST and UTC, text cascades."""
