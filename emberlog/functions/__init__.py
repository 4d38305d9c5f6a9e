"""Column expressions: severities, times, texts, JSON values, attributes, cursors."""
