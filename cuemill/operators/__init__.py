"""cuemill.operators"""
