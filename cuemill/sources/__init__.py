"""cuemill.sources"""
