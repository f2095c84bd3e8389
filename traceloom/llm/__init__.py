"""Operators of a training-data pipeline: packing, WARC derivatives, scoring, near duplicates, licences, chat, ids."""
