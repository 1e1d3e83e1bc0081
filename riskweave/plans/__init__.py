"""Registered query plans (the catalogue behind ``__spark_entry__``)."""
