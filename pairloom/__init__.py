"""Pairloom: batch analytics over paired text records, hidden vectors and corpora, on Spark."""
