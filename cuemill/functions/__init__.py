"""cuemill.functions"""
