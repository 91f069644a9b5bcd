"""Spark jobs over large collections of molecular chains: contacts, domains, intervals, scores, label clean-up."""
