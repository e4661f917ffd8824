"""lociweave.functions"""
