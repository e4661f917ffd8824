"""lociweave.streaming"""
