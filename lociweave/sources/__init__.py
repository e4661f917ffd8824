"""lociweave.sources"""
