"""Training-data operators: secrets, packing, decontamination, dedup, quality, WARC, licences."""
