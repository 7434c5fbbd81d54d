"""Tables of wide rows over Parquet, and the formats that come in and go out."""
